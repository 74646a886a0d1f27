"""Hash splits, leakage control and stable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(seed: str, key: Column) -> Column:
    """sha256(seed, NUL, lower-cased key): its first 8 hex digits over 0xFFFFFFFF."""
    digest = F.sha2(F.concat(F.lit(seed + "\0"), F.lower(key)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def bucket(seed: str, key: Column, train: float = 0.8, dev: float = 0.1) -> Column:
    x = unit_hash(seed, key)
    return F.when(x < train, "train").when(x < train + dev, "dev").otherwise("test")


def family(word: Column) -> Column:
    """The word's letters and plus signs, with doubled vowels collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), "[^a-z+]", ""), r"([aeiou])\1+", "$1")


def trainer_family(word: Column) -> Column:
    """As ``family``, but keeps apostrophes and takes w for v."""
    bare = F.translate(F.regexp_replace(F.lower(word), "[^a-z+']", ""), "w", "v")
    return F.regexp_replace(bare, r"([aeiou])\1+", "$1")


def length_band(n: Column) -> Column:
    return F.when(n <= 3, "1-3").when(n <= 6, "4-6").when(n <= 9, "7-9").when(n <= 14, "10-14").otherwise("15+")


def overlap(lexicon: DataFrame, test: DataFrame, key: str, weight: str, strong: int) -> DataFrame:
    """One row: lexicon keys that are in the test set, split by weight."""
    hit = lexicon.join(test.select(key).distinct(), key, "left_semi")
    return hit.agg(F.count("*").alias("total"), F.count_if(F.col(weight) < strong).alias("soft"), F.count_if(F.col(weight) >= strong).alias("strong"))


def purge(lexicon: DataFrame, test: DataFrame, key: str, weight: str, strong: int) -> DataFrame:
    """The lexicon without soft entries whose key is in the test set."""
    marked = lexicon.join(test.select(key).distinct().withColumn("__leak", F.lit(True)), key, "left")
    return marked.where(F.col("__leak").isNull() | (F.col(weight) >= strong)).drop("__leak")


def disjoint(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows none of whose keys the known rows have."""
    for key in keys:
        rows = rows.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows
