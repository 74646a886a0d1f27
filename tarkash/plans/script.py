"""Queries that no SQL expresses: rules of script applied to the words of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.functions.transliterate import phonetic_forms, transliterate
from tarkash.sources.tables import table


def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n, native, forms): each distinct word of the part names, transliterated once."""
    rows = table(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counts = rows.groupBy("word").agg(F.count("*").alias("n"))
    return counts.select("word", "n", transliterate(F.col("word")).alias("native"), F.array_join(phonetic_forms(F.col("word")), " ").alias("forms"))


QUERIES = {"q26_transliterate": transliterated}
