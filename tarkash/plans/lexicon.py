"""Corpus counts and completion indexes over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarkash.sources.tables import table


def words(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    text = F.lower("text")
    return table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("word"))


def token_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))


def prefix_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_unigrams(spark, sf_dir).where(F.length("word") >= 2)
    each = counts.withColumn("k", F.explode(F.sequence(F.lit(2), F.least(F.lit(6), F.length("word")))))
    each = each.select(F.expr("substring(word, 1, k)").alias("prefix"), "word", "n")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), "word"))
    return each.withColumn("rank", rank).where("rank <= 8")


QUERIES = {"q01_token_unigrams": token_unigrams, "q02_prefix_top8": prefix_top8}

UNIGRAMS = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word"

ORACLE = {
    "q01_token_unigrams": UNIGRAMS,
    "q02_prefix_top8": f"""
WITH c AS ({UNIGRAMS}),
e AS (SELECT substring(word, 1, k::INT) AS prefix, word, n FROM (SELECT *, unnest(range(2, least(6, length(word)) + 1)) AS k FROM c WHERE length(word) >= 2)),
r AS (SELECT prefix, word, n, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, word)::INT AS rank FROM e)
SELECT * FROM r WHERE rank <= 8""",
}
