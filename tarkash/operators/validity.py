"""How well a native word is attested, by itself and through its stems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.functions.script import orthography_penalty

# Endings that come off, and those a stem is tried with.
SUFFIXES = (
    "વાળાઓ", "વાળીઓ", "વાળું", "વાળી", "વાળા", "વાળો", "ીઓ", "ાઓ", "ોને", "ાને", "ીને", "ુંને", "માંથી", "માં", "થી", "ની", "નો", "ના", "ને", "નું",
    "નાં", "શે", "શો", "શું", "ીશ", "ીશું", "્યો", "્યા", "્યું", "તો", "તા", "તી", "તું", "તાં", "વું", "વા", "વાનું", "વાની", "વાના", "ે", "ો", "ા",
    "ી", "ું", "ાં",
)
EXTENSIONS = (
    "ે", "ો", "ા", "ી", "ું", "વું", "તું", "વા", "શે", "શો",
)


def validity(words: DataFrame, evidence: DataFrame, floor: int = 50) -> DataFrame:
    """(native, score, evidence, unigram, stem, attested, spell_ok, uni_strong, present) of distinct words.

    ``evidence(native, unigram, stem, attested)`` has one row a word. Each word is probed as its
    stems, bare and with every extension, by one equality join; the probes of a word meet in one
    aggregate. Null words are left out.
    """
    native = F.col("native")
    words = words.select("native").where("native is not null").distinct()
    known = evidence.select("native", F.coalesce("unigram", F.lit(0)).alias("u"), F.coalesce("stem", F.lit(0)).alias("s"), F.coalesce("attested", F.lit(False)).alias("a"))
    stems = [F.when(native.endswith(s) & (F.length(native) > len(s) + 1), native.substr(F.lit(1), F.length(native) - len(s))) for s in SUFFIXES]
    stem = F.explode(F.array_compact(F.array(*stems))).alias("stem")
    forms = F.explode(F.concat(F.array("stem"), *[F.array(F.concat("stem", F.lit(e))) for e in EXTENSIONS])).alias("probe")
    probes = words.select("native", stem).select("native", forms).distinct()
    found = probes.join(known.withColumnRenamed("native", "probe"), "probe")
    hit = F.greatest("u", "s", F.when(F.col("a"), floor).otherwise(0))
    real = F.greatest(F.when(F.col("u") > floor, F.col("u")).otherwise(0), F.col("s"))
    found = found.groupBy("native").agg(F.max(hit).alias("hit"), F.max(real).alias("real"))
    rows = words.join(known.withColumn("present", F.lit(True)), "native", "left").join(found, "native", "left")
    rows = rows.na.fill({"u": 0, "s": 0, "a": False, "present": False, "hit": 0, "real": 0})
    spell = F.when(F.col("a"), floor).otherwise(0)
    rows = rows.withColumns({"stem": F.greatest("s", "hit", spell), "real": F.greatest("s", "real")})
    share = F.when(F.col("u") > 0, 0.35).otherwise(0.7)
    score = F.log1p("u") + 0.35 * F.log1p(spell) + share * F.log1p("stem") - 0.25 * F.regexp_count(native, F.lit("્")) - orthography_penalty(native)
    return rows.select(
        "native",
        F.greatest(F.lit(0.0), score).alias("score"),
        F.greatest("u", "stem").cast("long").alias("evidence"),
        F.col("u").cast("long").alias("unigram"),
        F.col("stem").cast("long").alias("stem"),
        ((F.col("u") > 0) | (F.col("real") > 0)).alias("attested"),
        F.col("a").alias("spell_ok"),
        (F.col("u") > floor).alias("uni_strong"),
        "present",
    )
