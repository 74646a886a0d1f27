"""Labels of failures, gates on measures, stress words, and labels taken over from a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.script import is_gujarati_word
from tarkash.operators.insertion import settle

FLOOR = 50
VOWELS = "અઆઇઈઉઊઋએઐઑઓઔાિીુૂૃેૈૉોૌ"


def skeleton(native: Column, vowels: str = VOWELS) -> Column:
    """The word without the given vowels and without nasal signs."""
    return F.translate(native, vowels + "ંઁ", "")


def failure_signals(roman: Column, gold: Column, menu: Column, vowels: str = VOWELS) -> Column:
    """The names of all traits that a missed word has, or unknown; an empty menu has no vowel_length."""
    top = F.coalesce(F.get(menu, F.lit(0)), F.lit(""))
    tests = {
        "vowel_length": (top != "") & (top != gold) & (skeleton(top, vowels) == skeleton(gold, vowels)),
        "aspiration": roman.rlike("kh|gh|chh|jh|th|dh|ph|bh"),
        "dental_retroflex": roman.rlike("[tTdDnNlL]") | gold.rlike("[ટઠડઢણળ]"),
        "nasal_anusvara": roman.rlike("ng|ny|[nmM]") | gold.rlike("[ંઁનમણઙઞ]"),
        "conjunct_virama": gold.contains("્"),
        "suffix_morphology": roman.rlike(r"(?:ma|maa|manthi|thi|ni|no|na|ne|nu|nun|va|vu|ta|ti|to|tu|she|sho)\z"),
        "loanword_spelling": roman.rlike("tion|sion|sch|ck|qu|oo|ee|[cqxfz]"),
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def merge_labels(model: DataFrame, gold: DataFrame, margin: float, least: int) -> DataFrame:
    """(roman, native, verdict) of a model's ``candidates`` array<struct<native, log_prob>>, best first.

    A long enough roman's first candidate is novel if ``gold(roman, native)`` lacks the roman,
    overridden if it differs and leads the second by ``margin`` (a lone candidate always leads),
    else kept_gold, with gold's native. A badly formed first candidate is rejected_invalid. Rows
    without candidates are left out.
    """
    first, second = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    rows = model.where((F.length("roman") >= least) & (F.size("candidates") > 0)).select("roman", first["native"].alias("top"), F.coalesce(first["log_prob"] - second["log_prob"], F.lit(float("inf"))).alias("lead"))
    rows = rows.join(gold.select("roman", F.col("native").alias("gold")), "roman", "left")
    verdict = F.when(~is_gujarati_word(F.col("top")), "rejected_invalid").when(F.col("gold").isNull(), "novel_added").when((F.col("top") != F.col("gold")) & (F.col("lead") >= margin), "overridden").otherwise("kept_gold")
    rows = rows.withColumn("verdict", verdict)
    return rows.select("roman", F.when(F.col("verdict") == "kept_gold", F.col("gold")).otherwise(F.col("top")).alias("native"), "verdict")


def boost(counts: DataFrame, natives: DataFrame, longest: int = 64) -> DataFrame:
    """(word, n): counts raised to the floor for ``natives(word)``, but for forms of known stems.

    Stems are known from the counts and, in the order of words, from the natives taken before.
    """
    fresh = natives.select("word").where("word is not null").distinct()
    taken = settle(fresh, "word", F.col("word"), counts, longest).select("word", F.lit(FLOOR).cast("long").alias("n"))
    return counts.select("word", F.col("n").cast("long").alias("n")).unionByName(taken).groupBy("word").agg(F.max("n").alias("n"))


def stress(keys: DataFrame, most: int) -> DataFrame:
    """(roman, place): the keys, the keys with an a, and with v made w or an i added; no repeats.

    The first transform that gives a word counts; order is transform, then key.
    """
    key = F.col("roman")
    at = F.instr(key, "v")
    third = F.when(at > 0, F.concat(F.substring(key, F.lit(1), at - 1), F.lit("w"), F.substring(key, at + 1, F.length(key)))).otherwise(F.concat(key, F.lit("i")))
    rows = keys.where(F.col("roman") != "").select(key.alias("k"), F.posexplode(F.array(key, F.concat(key, F.lit("a")), third)).alias("t", "roman"))
    first = rows.groupBy("roman").agg(F.min(F.struct("t", "k")).alias("place"))
    return first.orderBy("place").limit(most)


def gates(measures: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """``measures`` with ``failures``: for each rule (column, ">=" or "<=", bound) that does not hold, its column.

    A missing measure fails.
    """
    failed = [F.when(~F.coalesce(F.col(c) >= x if op == ">=" else F.col(c) <= x, F.lit(False)), c) for c, op, x in rules]
    return measures.withColumn("failures", F.array_compact(F.array(*failed)))


def lead_over_next(rows: DataFrame, key: str, score: str) -> DataFrame:
    """Each key's best row with ``lead``, the distance to its second, null where there is none."""
    order = Window.partitionBy(key).orderBy(F.desc(score))
    ranked = rows.withColumns({"lead": F.col(score) - F.lead(score).over(order), "__r": F.row_number().over(order)})
    return ranked.where("__r = 1").drop("__r")
