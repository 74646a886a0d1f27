"""Non-equi lookups turned into equi-joins: suffixes, compounds and fuzzy forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffix_stems(typed: DataFrame, lexicon: DataFrame, suffixes: Sequence[str], least: int) -> DataFrame:
    """(word, stem, suffix, n): each split of ``typed(word)`` into a known stem and a rule's suffix.

    Suffix lengths are exploded, so both steps are equality tests and no pair of a word and a rule
    is made.
    """
    lengths = sorted({len(s) for s in suffixes})
    cuts = typed.select("word", F.explode(F.array(*[F.lit(k) for k in lengths])).alias("k")).where(F.length("word") - F.col("k") >= least)
    cuts = cuts.select("word", F.expr("substring(word, 1, length(word) - k)").alias("stem"), F.expr("right(word, k)").alias("suffix"))
    cuts = cuts.where(F.col("suffix").isin(*suffixes))
    return cuts.join(lexicon.select(F.col("word").alias("stem"), "n"), "stem").select("word", "stem", "suffix", "n")


def compounds(typed: DataFrame, lexicon: DataFrame, least_word: int = 8, least_part: int = 3) -> DataFrame:
    """(word, left, right, n): splits of long words into two known parts; n is the rarer part's count."""
    at = F.explode(F.sequence(F.lit(least_part), F.length("word") - least_part)).alias("k")
    cuts = typed.where(F.length("word") >= max(least_word, 2 * least_part)).select("word", at)
    cuts = cuts.select("word", F.expr("substring(word, 1, k)").alias("left"), F.expr("substring(word, k + 1)").alias("right"))
    found = cuts.join(lexicon.select(F.col("word").alias("left"), F.col("n").alias("n1")), "left")
    found = found.join(lexicon.select(F.col("word").alias("right"), F.col("n").alias("n2")), "right")
    return found.select("word", "left", "right", F.least("n1", "n2").alias("n"))


def lattice(words: DataFrame, pairs: Sequence[tuple[str, str, float]], passes: int, beam: int, most: Column) -> DataFrame:
    """(word, form, cost): forms reached by replacing pairs at any place, the cheapest ``beam`` a pass.

    Each pass explodes the places of every pair, keeps the smallest cost of a form and drops those
    over ``most`` (an expression of word). Order: cost, length, form.
    """
    forms = words.select("word", F.col("word").alias("form"), F.lit(0.0).alias("cost"))
    for _ in range(passes):
        moves = []
        for a, b, cost in pairs:
            places = F.filter(F.sequence(F.lit(1), F.length("form")), _stands(a))
            moves.append(F.transform(places, _swapped(a, b, cost)))
        step = forms.select("word", F.col("cost").alias("__c"), F.explode(F.concat(*moves)).alias("m"))
        step = step.select("word", F.col("m.form").alias("form"), (F.col("__c") + F.col("m.cost")).alias("cost")).where(F.col("cost") <= most)
        merged = forms.union(step).groupBy("word", "form").agg(F.min("cost").alias("cost"))
        order = Window.partitionBy("word").orderBy("cost", F.length("form"), "form")
        forms = merged.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= beam).drop("__r")
    return forms


def _stands(a: str):
    return lambda i: F.substring(F.col("form"), i, F.lit(len(a))) == a


def _swapped(a: str, b: str, cost: float):
    return lambda i: F.struct(F.concat(F.substring(F.col("form"), F.lit(1), i - 1), F.lit(b), F.substring(F.col("form"), i + len(a), F.length("form"))).alias("form"), F.lit(cost).alias("cost"))
