"""Readers of word lists, counts, pairs, dictionaries, emoji tables and evaluation files.

Lines that do not fit are left out, as are rows with a null; files are split by Spark unless a
format needs the whole file. Where the first of several equal rows would win in one ordered file,
the smallest value wins here, since a distributed read has no order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.functions.script import clean_wiki_token, emoji_codes, is_emoji_code, is_gujarati, is_quality, is_roman, nfc
from tarkash.sources.archives import tar_lines, zip_lines

GUJARATI_WORD = r"[઀-૿]{2,}"
EXTRA_WEIGHT = 1000


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _cell(i: int, by: str = "\t") -> Column:
    return F.trim(F.get(F.split("value", by), F.lit(i)))


def _whole(x: Column, default: int) -> Column:
    return F.coalesce(x.try_cast("double").try_cast("int"), F.lit(default))


def _pairs(rows: DataFrame, roman: Column, native: Column, n: Column) -> DataFrame:
    out = rows.select(F.lower(roman).alias("roman"), nfc(native).alias("native"), n.alias("n"))
    return out.where(is_roman(F.col("roman")) & is_gujarati(F.col("native")))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(roman, native, n) of tab-separated pairs; n is 1 where it is missing or no number."""
    return _pairs(lines(spark, path), _cell(0), _cell(1), _whole(_cell(2), 1))


def short_pairs(spark: SparkSession, path: str, least: int = 3, most: int = 14) -> DataFrame:
    return pairs(spark, path).where(F.length("roman").between(least, most))


def zipped_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(roman, native, n) of JSON lines in ZIP members, counted.

    The native is under native, native word or word, the roman under english, english word or
    roman. Where both are missing the first two values count, whichever is which.
    """
    rows = zip_lines(spark, path, r"(?i)\A(?!.*/\.).*(?:\.jsonl?\Z|train|valid|test)")
    m = rows.where(F.trim("value").startswith("{")).select(F.from_json(F.trim("value"), "map<string,string>").alias("m"))
    first = lambda *keys: F.coalesce(*[F.nullif(F.col("m").getItem(k), F.lit("")) for k in keys], F.lit(""))
    values = F.map_values("m")
    a, b = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    named = m.select("m", first("native", "native word", "word").alias("native"), first("english", "english word", "roman").alias("roman"))
    bare = (F.col("native") == "") & (F.col("roman") == "")
    swap = is_gujarati(b) & is_roman(a)
    named = named.select(
        F.when(bare, F.when(is_gujarati(a) & is_roman(b), a).when(swap, b)).otherwise(F.col("native")).alias("native"),
        F.when(bare, F.when(is_gujarati(a) & is_roman(b), b).when(swap, a)).otherwise(F.col("roman")).alias("roman"),
    )
    return _pairs(named, F.trim("roman"), F.col("native"), F.lit(1)).groupBy("roman", "native").agg(F.sum("n").alias("n"))


def tarred_pairs(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(roman, native, n) of native, roman, n lines in TAR members, summed over the members."""
    n = F.when(_cell(2).rlike(r"\A\d+\z"), _whole(_cell(2), 1)).otherwise(1)
    return _pairs(tar_lines(spark, path, pattern), _cell(1), _cell(0), n).groupBy("roman", "native").agg(F.sum("n").alias("n"))


def tarred_natives(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Distinct Gujarati words in the first two cells of TAR members."""
    rows = tar_lines(spark, path, pattern).select(F.explode(F.array(_cell(0), _cell(1))).alias("word"))
    return words_of(rows)


def words_of(rows: DataFrame) -> DataFrame:
    return rows.select(nfc(F.col("word")).alias("word")).where(is_gujarati(F.col("word"))).distinct()


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) of two tab-separated cells in either order, the largest n a word."""
    rows = lines(spark, path).where(F.size(F.split(F.trim("value"), "\t")) == 2).select(_cell(0).alias("a"), _cell(1).alias("b"))
    number = lambda c: F.col(c).rlike(r"\A\d+\z")
    flip = number("a") & is_gujarati(F.col("b"))
    rows = rows.where(flip | (number("b") & is_gujarati(F.col("a"))))
    rows = rows.select(nfc(F.when(flip, F.col("b")).otherwise(F.col("a"))).alias("word"), F.when(flip, F.col("a")).otherwise(F.col("b")).try_cast("long").alias("n"))
    return rows.groupBy("word").agg(F.max("n").alias("n"))


def trailing_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) of lines whose first token is a word and whose last is a number."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines(spark, path).select(F.get(parts, F.lit(0)).alias("word"), F.try_element_at(parts, F.lit(-1)).alias("n"), F.size(parts).alias("k"))
    rows = rows.where((F.col("k") >= 2) & F.col("n").rlike(r"\A\d+\z") & is_gujarati(F.col("word")))
    return rows.select(nfc(F.col("word")).alias("word"), F.col("n").try_cast("long").alias("n")).groupBy("word").agg(F.max("n").alias("n"))


def word_set(spark: SparkSession, path: str, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """Distinct (word): each line's first token, or what ``clean`` makes of the line."""
    raw = F.trim("value")
    plain = F.when(~raw.startswith("#"), F.split(raw, r"\s+").getItem(0))
    return words_of(lines(spark, path).select((clean(F.col("value")) if clean else plain).alias("word")))


def wiki_words(spark: SparkSession, path: str) -> DataFrame:
    return word_set(spark, path, clean_wiki_token)


def zipped_wiki_words(spark: SparkSession, path: str) -> DataFrame:
    return words_of(zip_lines(spark, path).select(clean_wiki_token(F.col("value")).alias("word")))


def hunspell(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stems of a spelling dictionary: flags, comments and the count line go."""
    raw = F.trim("value")
    return words_of(lines(spark, path).where(~raw.startswith("#")).select(F.split_part(raw, F.lit("/"), F.lit(1)).alias("word")))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct Gujarati words anywhere in ZIP members of UTF-8 or UTF-16 text."""
    found = F.regexp_extract_all("value", F.lit(GUJARATI_WORD), F.lit(0))
    return words_of(zip_lines(spark, path, guess=True).select(F.explode(found).alias("word")))


def corpus_counts(spark: SparkSession, path: str, top: int = 500_000) -> DataFrame:
    """(word, n) of the ``top`` most frequent words of running text, ties to the smaller word."""
    found = F.regexp_extract_all("value", F.lit(GUJARATI_WORD), F.lit(0))
    rows = lines(spark, path).select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "word").limit(top)


def merged_counts(*tables: DataFrame) -> DataFrame:
    """The largest n a word over tables of (word, n)."""
    rows = tables[0].select("word", "n")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("word", "n"))
    return rows.groupBy("word").agg(F.max("n").alias("n"))


def natives(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Distinct words of an extract: ``tsv`` (second cell, else the first), ``csv``, ``dump`` or ``txt``."""
    rows = lines(spark, path)
    tokens = F.regexp_extract_all("value", F.lit(GUJARATI_WORD), F.lit(0))
    cell = F.when(is_gujarati(_cell(1)), _cell(1)).when(is_gujarati(_cell(0)), _cell(0))
    if kind == "csv":
        return words_of(rows.select(F.explode(tokens).alias("word")))
    if kind == "dump":
        return words_of(rows.select(F.explode(F.when(cell.isNotNull(), F.array(cell)).otherwise(tokens)).alias("word")))
    return words_of(rows.select((cell if kind == "tsv" else F.col("value")).alias("word")))


def frequent_natives(spark: SparkSession, path: str, least: int = 20, longest: int = 20) -> DataFrame:
    return counts(spark, path).where((F.col("n") >= least) & (F.length("word") <= longest)).select("word")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(native, roman, weight) of the tab-separated body of a dictionary file; weight 100 if missing.

    Header lines hold no tab and no Gujarati, so each line is judged alone.
    """
    rows = lines(spark, path).where(F.col("value").contains("\t") & ~F.col("value").rlike(r"\A(?:#|---)"))
    rows = rows.select(_cell(0).alias("native"), F.lower(_cell(1)).alias("roman"), _whole(_cell(2), 100).alias("weight"))
    return rows.where(is_gujarati(F.col("native")) & (F.col("roman") != ""))


def probes(spark: SparkSession, path: str) -> DataFrame:
    """(roman, native, type, lm) of probe results of type 0 or 1."""
    rows = lines(spark, path).select(F.lower(_cell(0)).alias("roman"), _cell(1).alias("native"), _cell(2).try_cast("int").alias("type"), _cell(3).try_cast("double").alias("lm"))
    return rows.where(F.col("type").isin(0, 1) & is_gujarati(F.col("native")) & (F.col("roman") != ""))


def quality_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (word) of a JSON array that pass the quality test."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("word"))
    return rows.where(is_quality(F.col("word"))).distinct()


def emoji_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(code, emoji, weight) after a dictionary file's header; weights from 1000 up."""
    body = F.split(F.regexp_replace("value", r"(?s)\A.*?\.\.\.", ""), "\n")
    row = F.trim("line")
    part = lambda k: F.regexp_extract(row, r"\A(.*\S)\s+(\S+)\s+(\d+)\z", k)
    rows = spark.read.text(path, wholetext=True).select(F.explode(body).alias("line")).where(~row.startswith("#"))
    rows = rows.select(F.lower(part(2)).alias("code"), part(1).alias("emoji"), F.greatest(F.lit(EXTRA_WEIGHT), _whole(part(3), 0)).alias("weight"))
    return rows.where(is_emoji_code(F.col("code")))


def emoji_extra(spark: SparkSession, path: str) -> DataFrame:
    """(code, emoji, weight) of tab-separated lines; 1000 where the weight is missing."""
    weight = F.when(_cell(2).rlike(r"\A\d+\z"), _whole(_cell(2), EXTRA_WEIGHT)).otherwise(EXTRA_WEIGHT)
    rows = lines(spark, path).where(~F.trim("value").startswith("#")).select(F.lower(_cell(0)).alias("code"), _cell(1).alias("emoji"), weight.alias("weight"))
    return rows.where(is_emoji_code(F.col("code")) & (F.col("emoji") != ""))


def emoji_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(code, emoji) of a JSON map from emoji to keywords."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("emoji", "words"))
    rows = rows.select("emoji", F.explode("words").alias("w")).select("emoji", F.explode(emoji_codes(F.btrim("w", F.lit(":")))).alias("code"))
    return rows.select("code", "emoji").distinct()


def emoji_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(code, emoji) of nested annotations: an emoji's default words and its spoken name, a text or a list."""
    inner = F.get_json_object("value", "$.annotations.annotations")
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(inner, "map<string,struct<default:array<string>,tts:string>>")).alias("emoji", "m"))
    named = F.coalesce(F.from_json("m.tts", "array<string>"), F.array("m.tts"))
    spoken = F.when(F.col("m.tts").startswith("["), named).otherwise(F.array("m.tts"))
    words = F.concat(F.coalesce("m.default", F.array().cast("array<string>")), spoken)
    rows = rows.select("emoji", F.explode(words).alias("w")).select("emoji", F.explode(emoji_codes(F.col("w"))).alias("code"))
    return rows.select("code", "emoji").distinct()


def prefix_index(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, payload) rows of a text index; repeated prefixes stay rows of their own."""
    at = F.instr("value", "\t")
    rows = lines(spark, path).where(at > 1)
    return rows.select(F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("prefix"), F.expr("substring(value, instr(value, '\t') + 1)").alias("payload"))


def evidence(spark: SparkSession, unigrams: str, stems: str, attested: str) -> DataFrame:
    """(native, unigram, stem, attested): all words of three tables, zero and false where one lacks them."""
    uni = lines(spark, unigrams).where(_cell(1).rlike(r"\A\d+\z")).select(F.split("value", "\t").getItem(0).alias("native"), _cell(1).try_cast("long").alias("unigram"))
    stem = spark.read.text(stems, wholetext=True).select(F.explode(F.from_json("value", "map<string,long>")).alias("native", "stem"))
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.words"), "array<string>"), F.from_json("value", "array<string>"))
    seen = spark.read.text(attested, wholetext=True).select(F.explode(listed).alias("native")).distinct().withColumn("attested", F.lit(True))
    uni, stem = (t.groupBy("native").agg(F.max(c).alias(c)) for t, c in ((uni, "unigram"), (stem, "stem")))
    return uni.join(stem, "native", "full").join(seen, "native", "full").na.fill({"unigram": 0, "stem": 0, "attested": False})


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(roman, native) of JSON lines, under roman or input and native or gold."""
    rows = spark.read.schema("roman string, input string, native string, gold string").json(path)
    rows = rows.select(F.lower(F.coalesce("roman", "input")).alias("roman"), F.coalesce("native", "gold").alias("native"))
    return rows.where("roman is not null and native is not null")


def reports(spark: SparkSession, folder: str, pattern: str = "verification-*.json") -> DataFrame:
    """(path, report) of every report file under the folder, the report as JSON text."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("report"))
