"""Counting, merging and pruning of lexicon evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax(pairs: DataFrame, key: str, value: str, n: str = "n") -> DataFrame:
    """The value with the largest count of each key; ties go to the smaller value."""
    order = Window.partitionBy(key).orderBy(F.desc(n), value)
    return pairs.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def fan_in(best: DataFrame, value: str) -> DataFrame:
    """For how many keys each value is the best one."""
    return best.groupBy(value).agg(F.count("*").alias("fan_in"))


def max_merge(sources: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(word, n, sources): the largest transformed count over the sources, and who has the word.

    ``sources`` gives for each name counts(word, n) and an expression of n that scales or floors it.
    """
    rows = None
    for name, (counts, expr) in sources.items():
        part = counts.select("word", expr.cast("long").alias("n"), F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("word").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


def best_tier(sources: Column, tiers: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first tier, best first, one of whose sources holds the word."""
    out = F.lit(default)
    for tier, names in reversed(list(tiers)):
        out = F.when(F.arrays_overlap(sources, F.array(*[F.lit(x) for x in names])), tier).otherwise(out)
    return out


def stem_max(counts: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """(stem, n): the largest count of a word that is the stem or the stem and a suffix.

    A suffix comes off only if over one letter stays. Words are exploded by matching suffix, so
    the work is a word times its matches, and the maximum is taken before the shuffle.
    """
    word = F.col("word")
    cut = [F.when(F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 1), F.expr(f"substring(word, 1, length(word) - {len(s)})")) for s in suffixes]
    forms = F.filter(F.array(word, *cut), lambda x: x.isNotNull())
    return counts.select(F.explode(forms).alias("stem"), "n").groupBy("stem").agg(F.max("n").alias("n"))


def prune(merged: DataFrame, high: Sequence[str], corpus: Sequence[str], attested: Column, floor: int, soft: int) -> DataFrame:
    """Keeps words of a high source; attested ones over the floor or in a corpus; others from ``soft`` on."""
    has = lambda names: F.arrays_overlap("sources", F.array(*[F.lit(x) for x in names]))
    n = F.col("n")
    return merged.where(F.when(has(high), True).when(attested, (n > floor) | has(corpus)).otherwise(n >= soft))


def compact(merged: DataFrame, high: Sequence[str], curated: Sequence[str], wide: Sequence[str], corpus: Sequence[str], floor: int) -> DataFrame:
    """Drops words that only the wide sources attest, at or under the floor."""
    has = lambda names: F.arrays_overlap("sources", F.array(*[F.lit(x) for x in names]))
    return merged.where(F.when(has([*high, *curated]), True).when(has(wide), has(corpus) | (F.col("n") > floor)).otherwise(True))


def top_per_key(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """At most k rows a key, with ``rank``; Spark prunes each group before and after the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
