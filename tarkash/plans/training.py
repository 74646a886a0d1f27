"""Queries on training rows, samples and coefficients, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.operators import counts, training
from tarkash.plans import evidence
from tarkash.plans.evaluation import C, P
from tarkash.plans.lexicon import token_unigrams, words
from tarkash.plans.menus import LATIN, SCRIPT, values
from tarkash.sources.tables import table

FIXTURES = (("ghar", "ઘર"), ("kaam", "કામ"), ("the", "ધ"))
WEIGHTS = {"soft": -0.5, "log_uni": 0.2, "attested": 0.3, "transform_cost": -0.4}
BIAS = 0.1


def _native(word: str = "word") -> Column:
    return F.translate(word, LATIN, SCRIPT)


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = words(spark, sf_dir, name).groupBy("word").agg(F.count("*").alias("n"))
    return rows.select(F.col("word").alias("roman"), _native().alias("native"), "n", F.lit(name).alias("source"))


def _excluded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    marked = words(spark, sf_dir, "benchmark").distinct().where(F.length("word") % 3 == 0)
    return training.exclusions(marked.select(F.col("word").alias("roman"), _native().alias("native")))


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.training_pairs([_source(spark, sf_dir, "documents"), _source(spark, sf_dir, "conversations")], *_excluded(spark, sf_dir))


def family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_unigrams(spark, sf_dir).where(training.in_validation(F.col("word"))).select("word")


def label_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.label_targets([_source(spark, sf_dir, "conversations"), _source(spark, sf_dir, "documents")], _excluded(spark, sf_dir)[0], 5)


def oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = token_unigrams(spark, sf_dir).select(F.col("word").alias("roman"), "n")
    return training.oversampled(pairs, pairs.where("n % 4 = 0"), medium_copies=1, pseudo_copies=3).groupBy("roman").agg(F.max("copy").alias("copies"), F.count("*").alias("rows"))


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_unigrams(spark, sf_dir).select("word", training.noisy(F.col("word"), "s1").alias("noisy"))


def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.candidate_lists(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")
    return out.select("user_id", F.array_join("candidates", ",").alias("candidates"))


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = token_unigrams(spark, sf_dir).where("n >= 5").select(F.col("word").alias("roman"), _native().alias("native"))
    return training.shuffled(pairs, "17", 100)


def top_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.top_short(token_unigrams(spark, sf_dir).select(F.col("word").alias("roman"), _native().alias("native"), F.least("n", F.lit(40)).alias("weight")), 3, 60)


def probe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [words(spark, sf_dir, name).select(F.col("word").alias("roman")) for name in ("conversations", "benchmark")]
    return training.probe_words(lists, 500)


def expanded_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = token_unigrams(spark, sf_dir).select(F.col("word").alias("roman"), _native().alias("native"), F.col("n").alias("weight"))
    return training.expanded_gold(spark.createDataFrame(FIXTURES, "roman string, native string"), lexicon, "gold", 10, 60)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir).where(F.length("word") >= 2).withColumn("prefix", F.substring("word", 1, 2))
    top = counts.top_per_key(rows, "prefix", 6, F.desc("n"), F.col("word"))
    rank = F.col("rank")
    source = F.when(rank == 1, "strict").when(rank == 2, "stem_postfix").when(rank == 3, "phonetic")
    seen = training.features(F.col("prefix"), F.col("word"), F.col("n"), F.col("n"), F.col("n") % 2 == 0, source, rank * 0.5, rank % 3)
    return top.select(F.col("prefix").alias("roman"), (rank == 1).alias("gold"), *[c.alias(k) for k, c in seen.items()])


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.gradients(_ranked(spark, sf_dir), WEIGHTS, BIAS)
    return out.select("pairs", *[F.round(f, 6).alias(f) for f in training.FEATURES])


def digit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_unigrams(spark, sf_dir).select("word", training.digit_bucket(F.col("word")).alias("bucket"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir).withColumnRenamed("word", "native")
    stems = evidence.stem_max(spark, sf_dir).where("n >= 10").withColumnRenamed("stem", "native")
    return training.universe(rows.where("n % 3 = 0"), rows.where("n >= 5"), stems, words(spark, sf_dir, "benchmark").withColumnRenamed("word", "native"))


def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.source_statistics(evidence.merged(spark, sf_dir), ("documents",))


QUERIES = {
    "q64_training_pairs": training_pairs,
    "q65_family_split": family_split,
    "q66_label_targets": label_targets,
    "q67_oversampled": oversampled,
    "q68_noise": noise,
    "q69_candidate_lists": candidate_lists,
    "q70_shuffled": shuffled,
    "q71_top_short": top_short,
    "q72_probe_words": probe_words,
    "q73_expanded_gold": expanded_gold,
    "q74_gradients": gradients,
    "q75_digit_buckets": digit_buckets,
    "q76_universe": universe,
    "q77_source_statistics": source_statistics,
}

NATIVE = f"translate({{}}, '{LATIN}', '{SCRIPT}')"
FAMILY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({}, 'w', 'v'), 'a+', 'a', 'g'), 'e+', 'e', 'g'), 'i+', 'i', 'g'), 'o+', 'o', 'g'), 'u+', 'u', 'g')"
HASH = "('0x' || substr(sha256({}), 1, 8))::BIGINT"


def _counted(name: str) -> str:
    return f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {name}) GROUP BY word"


S = f"""WITH d AS MATERIALIZED ({_counted("documents")}), v AS MATERIALIZED ({_counted("conversations")}), x AS MATERIALIZED (SELECT DISTINCT word, {FAMILY.format("word")} AS family, {NATIVE.format("word")} AS native FROM ({_counted("benchmark")}) WHERE length(word) % 3 = 0)"""
VARIANTS = "list_filter([word, CASE WHEN contains(word, 'w') THEN replace(word, 'w', 'v') END, CASE WHEN contains(word, 'v') THEN replace(word, 'v', 'w') END, "
VARIANTS += ", ".join(f"CASE WHEN contains(word, '{a}') THEN substr(word, 1, instr(word, '{a}') - 1) || '{b}' || substr(word, instr(word, '{a}') + {len(a)}) END" for a, b in training.SHORTER)
VARIANTS += ", CASE WHEN contains(word, 'h') AND length(word) > 3 THEN substr(word, 1, instr(word, 'h') - 1) || substr(word, instr(word, 'h') + 1) END], lambda x: x IS NOT NULL)"
F_SQL = {
    "soft": "CASE WHEN n < 100 THEN 1.0 ELSE 0.0 END", "strong": "CASE WHEN n >= 100 THEN 1.0 ELSE 0.0 END", "stem_derived": "CASE WHEN r = 2 THEN 1.0 ELSE 0.0 END", "phonetic": "CASE WHEN r >= 3 THEN 1.0 ELSE 0.0 END", "log_uni": "ln(1 + n)",
    "log_weight": "ln(1 + n)", "attested": "CASE WHEN n % 2 = 0 THEN 1.0 ELSE 0.0 END", "roman_len_ratio": "length(word) / 2.0", "transform_cost": "r * 0.5", "user_count": "(r % 3)::DOUBLE",
}

ORACLE = {
    "q64_training_pairs": f"""{S}, u AS (SELECT word, max(n)::BIGINT AS n FROM (SELECT word, n FROM d UNION ALL SELECT word, n + 1 FROM v) GROUP BY word)
SELECT word AS roman, {NATIVE.format("word")} AS native, n FROM u WHERE length(word) <= 32 AND {FAMILY.format("word")} NOT IN (SELECT family FROM x) AND {NATIVE.format("word")} NOT IN (SELECT native FROM x)""",
    "q65_family_split": f"{C} SELECT word FROM c WHERE {HASH.format(FAMILY.format('word'))} % 100 < 2",
    "q66_label_targets": f"""{S} SELECT word AS roman, {NATIVE.format("word")} AS native, CASE WHEN word IN (SELECT word FROM v) THEN 'conversations' ELSE 'documents' END AS source
FROM (SELECT word FROM d UNION SELECT word FROM v) WHERE length(word) >= 5 AND {FAMILY.format("word")} NOT IN (SELECT family FROM x)""",
    "q67_oversampled": f"{C} SELECT word AS roman, k::INT AS copies, k::BIGINT AS rows FROM (SELECT word, CASE WHEN length(word) <= 4 THEN 3 WHEN n % 4 = 0 THEN 3 WHEN length(word) < 8 THEN 2 ELSE 1 END AS k FROM c)",
    "q68_noise": f"{C} SELECT word, v[({HASH.format(chr(39) + 's1' + chr(39) + ' || chr(0) || word')} % len(v))::INT + 1] AS noisy FROM (SELECT word, {VARIANTS} AS v FROM c)",
    "q69_candidate_lists": "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS candidates FROM (SELECT user_id, event_type, min(ts) AS ts, first(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY user_id, event_type) GROUP BY user_id",
    "q70_shuffled": f"{C} SELECT word AS roman, {NATIVE.format('word')} AS native FROM c WHERE n >= 5 ORDER BY sha256('17' || chr(0) || word || chr(0) || {NATIVE.format('word')}) LIMIT 100",
    "q71_top_short": f"{C} SELECT word AS roman, {NATIVE.format('word')} AS native, least(n, 40) AS weight FROM c WHERE length(word) BETWEEN 1 AND 3 ORDER BY least(n, 40) DESC, sha256('short' || chr(0) || word || chr(0) || {NATIVE.format('word')}) LIMIT 60",
    "q72_probe_words": f"SELECT word AS roman FROM (SELECT word FROM ({_counted('conversations')}) UNION SELECT word FROM ({_counted('benchmark')})) ORDER BY length(word), word LIMIT 500",
    "q73_expanded_gold": f"""{C}, f AS (SELECT * FROM {values(FIXTURES, "roman, native")}), a AS (SELECT roman, native, TRUE AS fixed FROM f UNION ALL SELECT word, {NATIVE.format("word")}, FALSE FROM c WHERE n >= 10 AND length(word) BETWEEN 3 AND 12 AND word NOT IN (SELECT roman FROM f))
SELECT roman, native FROM a ORDER BY fixed DESC, CASE WHEN fixed THEN '' ELSE sha256('gold' || chr(0) || roman) END, roman LIMIT 60""",
    "q74_gradients": f"""{P}, k AS (SELECT prefix, r, {", ".join(f"({e})::DOUBLE AS {f}" for f, e in F_SQL.items())} FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, word) AS r FROM p) WHERE r <= 6),
s AS MATERIALIZED (SELECT *, {BIAS} + {" + ".join(f"{f} * ({w})" for f, w in WEIGHTS.items())} AS score FROM k),
m AS (SELECT {", ".join(f"g.{f} - o.{f} AS {f}" for f in F_SQL)}, g.score - o.score AS margin FROM s o JOIN s g ON g.prefix = o.prefix AND g.r = 1 WHERE o.r > 1)
SELECT count(*) AS pairs, {", ".join(f"round(sum((CASE WHEN margin >= 20 THEN 1.0 WHEN margin <= -20 THEN 0.0 ELSE 1.0 / (1.0 + exp(-margin)) END - 1.0) * {f}), 6) AS {f}" for f in F_SQL)} FROM m""",
    "q75_digit_buckets": f"{C} SELECT word, CASE WHEN d < 8 THEN 'train' WHEN d = 8 THEN 'val' ELSE 'test' END AS bucket FROM (SELECT word, list_sum(list_transform(range(1, length(word) + 1), lambda i: ascii(substr(word, i, 1)))) % 10 AS d FROM c)",
    "q76_universe": f"""{C}, st AS ({evidence.ORACLE["q07_stem_max"]}), b AS (SELECT DISTINCT word FROM ({_counted("benchmark")}))
SELECT native, coalesce(max(u), 0)::BIGINT AS unigram, coalesce(max(s), 0)::BIGINT AS stem, coalesce(bool_or(a), FALSE) AS attested FROM (
  SELECT word AS native, NULL::BIGINT AS u, NULL::BIGINT AS s, NULL::BOOLEAN AS a FROM c WHERE n % 3 = 0 UNION ALL SELECT word, n, NULL, NULL FROM c WHERE n >= 5 UNION ALL SELECT stem, NULL, n, NULL FROM st WHERE n >= 10 UNION ALL SELECT word, NULL, NULL, TRUE FROM b) GROUP BY native""",
    "q77_source_statistics": f"""WITH m AS MATERIALIZED ({evidence.ORACLE["q06_provenance_tiers"]}) SELECT 'union' AS name, count(*) AS words FROM m UNION ALL SELECT 'wide_only', count(*) FROM m WHERE sources = 'documents'
UNION ALL SELECT name, count(*) FROM (SELECT unnest(string_split(sources, ',')) AS name FROM m) GROUP BY name""",
}
