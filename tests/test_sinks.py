from pyspark.sql import functions as F

from tarkash.operators.splits import bucket
from tarkash.sources import sinks, text


def test_tables_come_back(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    lexicon = spark.createDataFrame([("b", "ખ", 1), ("a", "ક", 2)], "roman string, native string, weight int")
    sinks.lexicon(lexicon, at("lex"))
    assert {tuple(r) for r in spark.read.parquet(at("lex")).collect()} == {("a", "ક", 2), ("b", "ખ", 1)}
    sinks.prefix_index(lexicon.withColumnRenamed("roman", "prefix"), at("idx"))
    assert spark.read.parquet(at("idx")).where("size = 1").count() == 2
    sinks.evidence(lexicon.select("native", F.col("weight").alias("unigram")), at("ev"), at("meta"), 50)
    assert spark.read.json(at("meta")).first().asDict() == {"version": 2, "words": 2, "max_unigram": 2, "attested_floor": 50}
    sinks.splits(lexicon, at("split"), bucket("s", F.col("roman")))
    assert spark.read.parquet(at("split")).count() == 2
    assert sinks.bad_rows(lexicon, heavy=F.col("weight") > 1, named=F.col("roman").isNotNull()).first().asDict() == {"heavy": 1, "named": 0}


def test_ranked_words_and_json(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    counts = spark.createDataFrame([("કખ", 5), ("ગઘ", 7), ("ચછ", 5)], "word string, n int")
    sinks.ranked(counts, at("top"), top=2)
    assert {tuple(r) for r in text.counts(spark, at("top")).collect()} == {("ગઘ", 7), ("કખ", 5)}
    sinks.attested(counts, at("att"), 50)
    assert spark.read.json(at("att")).count() == 3
    merged = counts.withColumn("sources", F.array(F.lit("b"), F.lit("a")))
    sinks.unique_words(merged, at("uniq"), F.lit("T0"))
    assert {r.value for r in spark.read.text(at("uniq")).collect()} == {"કખ\tT0\ta,b", "ગઘ\tT0\ta,b", "ચછ\tT0\ta,b"}
    menus = spark.createDataFrame([("x", ["ક"]), ("ક", ["ક", "x"]), ("y", []), ("z", None)], "native string, menu array<string>")
    sinks.disagreements(menus, at("dis"))
    assert {r.native for r in spark.read.json(at("dis")).collect()} == {"x", "y", "z"}
    sinks.jsonl(menus, at("j"))
    assert spark.read.json(at("j")).count() == 4
