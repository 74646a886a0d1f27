"""Emoji keyword tables: which sequences count, which source wins, and the lookups menus use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CURATED = ("curated_gu", "gu_extra")


def is_sequence(text: Column) -> Column:
    """Not empty, no replacement mark, control or surrogate, no selector or joiner first, no joiner last."""
    bad = text.rlike("[\\p{Cc}\\p{Cs}�]|\\A[︎️‍]|‍\\z")
    return F.coalesce((text != "") & ~bad, F.lit(False))


def keep_first(rows: DataFrame, sources: Sequence[str]) -> DataFrame:
    """(code, emoji, weight, source) once a code and emoji: the source named first, then the larger weight."""
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    fine = rows.where((F.col("code") != "") & is_sequence(F.col("emoji")) & (place > 0))
    first = fine.groupBy("code", "emoji").agg(F.min(F.struct(place.alias("p"), (-F.col("weight")).alias("w"), "source")).alias("f"))
    return first.select("code", "emoji", (-F.col("f.w")).alias("weight"), "f.source")


def capped(rows: DataFrame, confidence: dict[str, float], most: int = 6) -> DataFrame:
    """``keep_first`` rows with their source's confidence and a rank, the ``most`` surest and heaviest a code."""
    sure = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in confidence.items() for x in (k, float(v))]), F.col("source")), F.lit(0.0))
    rows = rows.withColumn("confidence", sure)
    order = Window.partitionBy("code").orderBy(F.desc("confidence"), F.desc("weight"), "emoji")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def by_native(keywords: DataFrame, lexicon: DataFrame, curated: Sequence[str] = CURATED) -> DataFrame:
    """(native, emoji, weight, confidence): curated keywords through the lexicon, and their own ``natives`` if they have any.

    ``keywords(code, emoji, weight, confidence, source)``, with or without ``natives`` array<string>.
    """
    via = keywords.where(F.col("source").isin(*curated)).join(lexicon.select(F.col("roman").alias("code"), "native"), "code").select("native", "emoji", "weight", "confidence")
    if "natives" in keywords.columns:
        via = via.unionByName(keywords.select(F.explode("natives").alias("native"), "emoji", "weight", "confidence"))
    best = via.groupBy("native", "emoji").agg(F.max(F.struct("confidence", "weight")).alias("b"))
    return best.select("native", "emoji", "b.weight", "b.confidence")


def missing(required: Column, available: Column) -> Column:
    """What is required and not there, sorted; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.coalesce(required, none), F.coalesce(available, none)))


def evidence_payload(text: Column) -> Column:
    """struct<unigram, stem, attested> of a packed payload, parts by tab or unit separator; what is no number is 0."""
    parts = F.split(text, "[\t\x1f]", -1)
    number = lambda i: F.coalesce(F.get(parts, i).try_cast("bigint"), F.lit(0))
    return F.struct(number(0).alias("unigram"), number(1).alias("stem"), (number(2) == 1).alias("attested"))
