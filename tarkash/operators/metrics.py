"""Ranking metrics, failure classes, percentiles and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position(menu: Column, gold: Column) -> Column:
    """The 1-based place of gold in the menu, null if it is not there."""
    at = F.array_position(menu, gold)
    return F.when(at > 0, at)


def ranking(rows: DataFrame, place: str, *by: str) -> DataFrame:
    """n, top1, top3, recall6, mrr and ndcg6 over all rows and, with ``by``, for each value too (null is all)."""
    p = F.col(place)
    six = F.coalesce(p <= 6, F.lit(False))
    measures = [
        F.count("*").alias("n"),
        F.avg(F.coalesce((p == 1).cast("double"), F.lit(0.0))).alias("top1"),
        F.avg(F.coalesce((p <= 3).cast("double"), F.lit(0.0))).alias("top3"),
        F.avg(six.cast("double")).alias("recall6"),
        F.avg(F.when(six, 1.0 / p).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(six, 1.0 / F.log2(p + 1)).otherwise(0.0)).alias("ndcg6"),
    ]
    return rows.groupingSets([list(by), []], *by).agg(*measures) if by else rows.agg(*measures)


def failure(place: Column) -> Column:
    return F.when(place.isNull(), "missing").when(place == 1, "top1").when(place <= 6, "wrong_order").otherwise("below6")


def nth_percentile(rows: DataFrame, key: str, value: str, p: float, accuracy: int = 10_000) -> DataFrame:
    """sorted[min(n - 1, floor(n * p))] of each key, exactly.

    A quantile sketch bounds the value from both sides; the values below the bounds are counted and
    only those between them, a few in ``accuracy`` of a key, are sorted, with their repeats as one.
    """
    rows = rows.where(F.col(value).isNotNull()).select(key, value)
    ends = [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
    bounds = rows.groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx(value, ends, accuracy).alias("b"))
    marked = rows.join(bounds, key)
    below = marked.where(F.col(value) < F.col("b")[0]).groupBy(key).agg(F.count("*").alias("below"))
    near = marked.where(F.col(value).between(F.col("b")[0], F.col("b")[1])).groupBy(key, "n", value).agg(F.count("*").alias("m"))
    near = near.join(below, key, "left").na.fill({"below": 0})
    upto = F.col("below") + F.sum("m").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p)))
    return near.withColumn("upto", upto).where((F.col("upto") > at) & (F.col("upto") - F.col("m") <= at)).select(key, "n", F.col(value).alias("value"))


def examples(rows: DataFrame, label: str, k: int, *order: Column) -> DataFrame:
    """Each label's count and at most k of its rows."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    return ranked.where(F.col("rank") <= k).join(rows.groupBy(label).agg(F.count("*").alias("total")), label)
