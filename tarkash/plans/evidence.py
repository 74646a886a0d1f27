"""Queries on evidence merging, splits, metrics, lookups and learning, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarkash.operators import counts, learning, lookup, menu, metrics, splits
from tarkash.plans.lexicon import UNIGRAMS, token_unigrams, words
from tarkash.sources.tables import table

SUFFIXES = ("tion", "ing", "ed", "er", "en", "s")
CONFUSIONS = (("i", "ee", 1.0), ("ee", "i", 1.0), ("u", "oo", 1.0), ("oo", "u", 1.0), ("w", "v", 1.5), ("v", "w", 1.5), ("s", "sh", 2.0), ("sh", "s", 2.0))
TIERS = (("T0", ("benchmark",)), ("T1", ("conversations",)), ("T3", ("documents",)))


def words_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return rows.groupBy("word", "lang").agg(F.count("*").alias("n"))


def pair_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.argmax(words_by_lang(spark, sf_dir), "word", "lang")


def native_fanin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.fan_in(pair_argmax(spark, sf_dir), "lang")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    each = {name: words(spark, sf_dir, name).groupBy("word").agg(F.count("*").alias("n")) for name in ("documents", "benchmark", "conversations")}
    return counts.max_merge({"documents": (each["documents"], n), "benchmark": (each["benchmark"], F.greatest(n * 2, F.lit(90))), "conversations": (each["conversations"], F.greatest(n, F.lit(40)))})


def max_merge_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("word", "n")


def provenance_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merged(spark, sf_dir)
    return out.select("word", F.array_join("sources", ",").alias("sources"), counts.best_tier(F.col("sources"), TIERS, "T3").alias("tier"))


def stem_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.stem_max(token_unigrams(spark, sf_dir), SUFFIXES)


def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    attested = F.array_contains("sources", "conversations")
    return counts.prune(merged(spark, sf_dir), ["benchmark"], ["documents"], attested, 40, 3).select("word", "n")


def keyword_cap6(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.explode(F.split(F.lower("p_name"), " ")).alias("token")
    pairs = table(spark, sf_dir, "part").select(F.col("p_type").alias("keyword"), token).groupBy("keyword", "token").agg(F.count("*").alias("n"))
    return counts.top_per_key(pairs, "keyword", 6, F.desc("n"), F.col("token"))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir).withColumn("bucket", splits.bucket("frozen", F.col("word")))
    return rows.groupBy("bucket").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


def leakage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.overlap(token_unigrams(spark, sf_dir), words(spark, sf_dir, "benchmark"), "word", "n", 100)


def leakage_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.purge(token_unigrams(spark, sf_dir), words(spark, sf_dir, "benchmark"), "word", "n", 100)


def source_disjoint_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pair_argmax(spark, sf_dir).withColumn("family", splits.family(F.col("word")))
    known = words(spark, sf_dir, "benchmark").select("word", splits.family(F.col("word")).alias("family"))
    free = splits.disjoint(rows, known, "word", "family").withColumn("digest", F.sha2("word", 256))
    return counts.top_per_key(free, "lang", 100, F.col("digest"), F.col("word")).select("lang", "word", "rank")


def roman_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir).select(splits.family(F.col("word")).alias("family"), "n")
    return rows.groupBy("family").agg(F.count("*").alias("words"), F.sum("n").alias("n"))


def quality_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir)
    soft, size = F.col("n") < 3, F.length("word")
    stem = F.expr("substring(word, 1, length(word) - 3)")
    known = rows.select(F.col("word").alias("stem")).withColumn("known", F.lit(True))
    rows = rows.withColumn("stem", F.when(soft & F.endswith("word", F.lit("ing")) & (size > 4), stem)).join(known, "stem", "left")
    reason = F.when(soft & (size > 16), "soft_long").when(size > 28, "hard_long").when(F.col("known"), "soft_postfix_dup").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("words"))


def _menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types by frequency as a menu, and the type of the last event as gold."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    kinds = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    menus = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "event_type"))).alias("m"))
    menus = menus.select("user_id", F.transform("m", lambda x: x["event_type"]).alias("menu"))
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("gold"))
    return menus.join(last, "user_id").withColumn("place", metrics.position(F.col("menu"), F.col("gold")))


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking(_menus(spark, sf_dir), "place")


def metrics_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the most frequent language of a word's first two letters predicts the word's own."""
    rows = pair_argmax(spark, sf_dir).select("word", "lang").where(F.length("word") >= 2).withColumn("prefix", F.substring("word", 1, 2))
    order = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("c"), "lang"))
    places = rows.groupBy("prefix", "lang").agg(F.count("*").alias("c")).withColumn("place", order)
    rows = rows.join(places, ["prefix", "lang"]).withColumn("band", splits.length_band(F.length("word")))
    return metrics.ranking(rows, "place", "band")


def failure_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _menus(spark, sf_dir).withColumn("place", metrics.position(F.slice("menu", 1, 3), F.col("gold")))
    return cut.groupBy(metrics.failure(F.col("place")).alias("class")).agg(F.count("*").alias("n"))


def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nth_percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.95)


def cluster_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir)
    flags = {"doubled": r"(aa|ee|ii|oo|uu)", "aspirate": "[bcdgkpt]h", "long": "^.{13,}$", "vowel_end": "[aeiou]$"}
    labels = F.array(*[F.when(F.regexp_like("word", F.lit(p)), name) for name, p in flags.items()])
    rows = rows.select("word", "n", F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("label"))
    return metrics.examples(rows, "label", 8, F.desc("n"), F.col("word"))


def learning_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return learning.preferred(rows, "user_id", "event_type", "ts", "event_id").select("user_id", "preferred")


def learning_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.store(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), "user_id", "event_type", "ts")


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word <> ''").distinct()


def lattice_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.when(F.length("word") <= 3, 1.0).when(F.length("word") <= 6, 3.0).otherwise(4.0)
    return lookup.lattice(part_tokens(spark, sf_dir), CONFUSIONS, 2, 16, most)


def suffix_stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = token_unigrams(spark, sf_dir)
    return lookup.suffix_stems(lexicon.select("word"), lexicon.where("n >= 3"), SUFFIXES, 2)


def compound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = token_unigrams(spark, sf_dir)
    return lookup.compounds(lexicon.select("word"), lexicon.where("n >= 20"))


def menu_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menus of a brand's parts, with tiers by size class."""
    parts = table(spark, sf_dir, "part")
    tier = (F.col("p_size") % 6).cast("int")
    rows = parts.select(F.col("p_brand").alias("typed"), F.col("p_name").alias("native"), tier.alias("tier"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 4).alias("closeness"), F.col("p_size").alias("weight"), F.col("p_partkey").alias("index"), ((F.col("p_partkey") % 10) / 10.0).alias("confidence"))
    rows = counts.top_per_key(rows, "typed", 24, F.col("index")).drop("rank")
    items = menu.ranked(rows, "typed").groupBy("typed").agg(F.array_sort(F.collect_list(F.struct("rank", "native", "tier", "confidence"))).alias("items"))
    return items.select("typed", F.array_join(menu.layout(F.col("items"), confidence=0.5), "|").alias("menu"))


NAMES = [pair_argmax, native_fanin, max_merge_floors, provenance_tiers, stem_max, prune, keyword_cap6, hash_split, leakage_overlap, leakage_purge, source_disjoint_sample, roman_family, quality_filter_reasons, rank_metrics, metrics_by_band, failure_partition, latency_percentile, cluster_examples, learning_preferred, lattice_two_pass, suffix_stem_join, compound_split, menu_layout]
QUERIES = {f"q{i:02d}_{f.__name__}": f for i, f in enumerate(NAMES, 3)} | {"q27_learning_store": learning_store}

TOKENS = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {}"
PAIRS = "SELECT word, lang, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY ALL"
BEST = f"SELECT word, lang, n FROM ({PAIRS}) QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, lang) = 1"
MERGED = f"""SELECT word, max(n)::BIGINT AS n, list_sort(list(DISTINCT source)) AS sources FROM (
  SELECT word, count(*) AS n, 'documents' AS source FROM ({TOKENS.format("documents")}) GROUP BY word
  UNION ALL SELECT word, greatest(count(*) * 2, 90), 'benchmark' FROM ({TOKENS.format("benchmark")}) GROUP BY word
  UNION ALL SELECT word, greatest(count(*), 40), 'conversations' FROM ({TOKENS.format("conversations")}) GROUP BY word) GROUP BY word"""
BANDS = "CASE WHEN length(word) <= 3 THEN '1-3' WHEN length(word) <= 6 THEN '4-6' WHEN length(word) <= 9 THEN '7-9' WHEN length(word) <= 14 THEN '10-14' ELSE '15+' END"
COLLAPSED = "word"
for _v in "aeiou":
    COLLAPSED = f"regexp_replace({COLLAPSED}, '{_v}{_v}+', '{_v}', 'g')"
MEASURES = """count(*) AS n, avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0.0 END) AS top3,
  avg(CASE WHEN place <= 6 THEN 1.0 ELSE 0.0 END) AS recall6, avg(CASE WHEN place <= 6 THEN 1.0 / place ELSE 0.0 END) AS mrr,
  avg(CASE WHEN place <= 6 THEN 1.0 / log2(place + 1) ELSE 0.0 END) AS ndcg6"""
MENUS = """SELECT user_id, menu, gold, CASE WHEN list_position(menu, gold) > 0 THEN list_position(menu, gold) END AS place FROM
  (SELECT user_id, list(event_type ORDER BY n DESC, event_type) AS menu FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)
  JOIN (SELECT user_id, event_type AS gold FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) USING (user_id)"""
IN_SUFFIXES = ", ".join(f"'{s}'" for s in SUFFIXES)
FLAGS = "CASE WHEN regexp_matches(word, '(aa|ee|ii|oo|uu)') THEN 'doubled' END, CASE WHEN regexp_matches(word, '[bcdgkpt]h') THEN 'aspirate' END, CASE WHEN length(word) >= 13 THEN 'long' END, CASE WHEN regexp_matches(word, '[aeiou]$') THEN 'vowel_end' END"


def _lattice_sql() -> str:
    rules = ", ".join(f"('{a}', '{b}', {c})" for a, b, c in CONFUSIONS)
    most = "CASE WHEN length(word) <= 3 THEN 1.0 WHEN length(word) <= 6 THEN 3.0 ELSE 4.0 END"
    sql = f"""WITH rules AS (SELECT * FROM (VALUES {rules}) t(a, b, c)),
f0 AS (SELECT DISTINCT word, word AS form, 0.0::DOUBLE AS cost FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word <> '')"""
    for i in (0, 1):
        sql += f""",
s{i} AS (SELECT word, substring(form, 1, i - 1) || b || substring(form, i + length(a)) AS form, cost + c AS cost
  FROM (SELECT word, form, cost, unnest(range(1, length(form) + 1))::INT AS i FROM f{i}) JOIN rules ON substring(form, i, length(a)) = a),
f{i + 1} AS (SELECT word, form, min(cost)::DOUBLE AS cost FROM (SELECT * FROM f{i} UNION ALL SELECT * FROM s{i} WHERE cost <= {most}) GROUP BY word, form
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY min(cost), length(form), form) <= 16)"""
    return sql + "\nSELECT * FROM f2"


ORACLE = {
    "q03_pair_argmax": BEST,
    "q04_native_fanin": f"SELECT lang, count(*) AS fan_in FROM ({BEST}) GROUP BY lang",
    "q05_max_merge_floors": f"SELECT word, n FROM ({MERGED})",
    "q06_provenance_tiers": f"SELECT word, array_to_string(sources, ',') AS sources, CASE WHEN list_contains(sources, 'benchmark') THEN 'T0' WHEN list_contains(sources, 'conversations') THEN 'T1' ELSE 'T3' END AS tier FROM ({MERGED})",
    "q07_stem_max": f"""WITH c AS ({UNIGRAMS}) SELECT stem, max(n) AS n FROM (SELECT word AS stem, n FROM c UNION ALL
  SELECT substring(word, 1, length(word) - length(s)), n FROM c, (SELECT unnest([{IN_SUFFIXES}]) AS s) WHERE ends_with(word, s) AND length(word) > length(s) + 1) GROUP BY stem""",
    "q08_prune": f"SELECT word, n FROM ({MERGED}) WHERE CASE WHEN list_contains(sources, 'benchmark') THEN TRUE WHEN list_contains(sources, 'conversations') THEN n > 40 OR list_contains(sources, 'documents') ELSE n >= 3 END",
    "q09_keyword_cap6": "SELECT p_type AS keyword, token, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, token)::INT AS rank FROM (SELECT p_type, unnest(string_split(lower(p_name), ' ')) AS token FROM part) GROUP BY p_type, token QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, token) <= 6",
    "q10_hash_split": f"SELECT CASE WHEN x < 0.8 THEN 'train' WHEN x < 0.9 THEN 'dev' ELSE 'test' END AS bucket, count(*) AS words, sum(n)::BIGINT AS n FROM (SELECT n, ('0x' || substring(sha256('frozen' || chr(0) || word), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS x FROM ({UNIGRAMS})) GROUP BY 1",
    "q11_leakage_overlap": f"SELECT count(*) AS total, count(*) FILTER (WHERE n < 100) AS soft, count(*) FILTER (WHERE n >= 100) AS strong FROM ({UNIGRAMS}) WHERE word IN ({TOKENS.format('benchmark')})",
    "q12_leakage_purge": f"SELECT word, n FROM ({UNIGRAMS}) WHERE n >= 100 OR word NOT IN ({TOKENS.format('benchmark')})",
    "q13_source_disjoint_sample": f"""WITH b AS (SELECT DISTINCT word, {COLLAPSED} AS family FROM ({TOKENS.format('benchmark')})),
r AS (SELECT word, lang, {COLLAPSED} AS family FROM ({BEST}))
SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY sha256(word), word)::INT AS rank FROM r
WHERE word NOT IN (SELECT word FROM b) AND family NOT IN (SELECT family FROM b) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(word), word) <= 100""",
    "q14_roman_family": f"SELECT {COLLAPSED} AS family, count(*) AS words, sum(n)::BIGINT AS n FROM ({UNIGRAMS}) GROUP BY 1",
    "q15_quality_filter_reasons": f"""WITH c AS ({UNIGRAMS}) SELECT CASE WHEN n < 3 AND length(word) > 16 THEN 'soft_long' WHEN length(word) > 28 THEN 'hard_long'
  WHEN n < 3 AND ends_with(word, 'ing') AND length(word) > 4 AND substring(word, 1, length(word) - 3) IN (SELECT word FROM c) THEN 'soft_postfix_dup' ELSE 'kept' END AS reason, count(*) AS words FROM c GROUP BY 1""",
    "q16_rank_metrics": f"SELECT {MEASURES} FROM ({MENUS})",
    "q17_metrics_by_band": f"""WITH r AS (SELECT word, lang, substring(word, 1, 2) AS prefix FROM ({BEST}) WHERE length(word) >= 2),
p AS (SELECT prefix, lang, row_number() OVER (PARTITION BY prefix ORDER BY count(*) DESC, lang) AS place FROM r GROUP BY prefix, lang)
SELECT {BANDS} AS band, {MEASURES} FROM r JOIN p USING (prefix, lang) GROUP BY GROUPING SETS ((1), ())""",
    "q18_failure_partition": f"SELECT CASE WHEN p = 0 OR p IS NULL THEN 'missing' WHEN p = 1 THEN 'top1' WHEN p <= 6 THEN 'wrong_order' ELSE 'below6' END AS class, count(*) AS n FROM (SELECT list_position(menu[1:3], gold) AS p FROM ({MENUS})) GROUP BY 1",
    "q19_latency_percentile": "SELECT event_type, n, v[least(n - 1, floor(n * 0.95))::BIGINT + 1] AS value FROM (SELECT event_type, count(value) AS n, list(value ORDER BY value) FILTER (WHERE value IS NOT NULL) AS v FROM events GROUP BY event_type)",
    "q20_cluster_examples": f"""WITH r AS (SELECT word, n, label FROM (SELECT word, n, unnest([{FLAGS}]) AS label FROM ({UNIGRAMS})) WHERE label IS NOT NULL)
SELECT label, word, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, word)::INT AS rank, count(*) OVER (PARTITION BY label) AS total FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, word) <= 8""",
    "q21_learning_preferred": """SELECT user_id, event_type AS preferred FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
WHERE k >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "q22_lattice_two_pass": _lattice_sql(),
    "q23_suffix_stem_join": f"""WITH c AS MATERIALIZED ({UNIGRAMS}), k AS (SELECT word, s AS suffix, substring(word, 1, length(word) - length(s)) AS stem FROM c, (SELECT unnest([{IN_SUFFIXES}]) AS s) WHERE ends_with(word, s))
SELECT k.word, k.stem, k.suffix, b.n FROM k JOIN c b ON b.word = k.stem WHERE b.n >= 3 AND length(k.stem) >= 2""",
    "q24_compound_split": f"""WITH c AS MATERIALIZED ({UNIGRAMS}), k AS (SELECT word, unnest(range(3, length(word) - 2))::INT AS i FROM c WHERE length(word) >= 8)
SELECT k.word, a.word AS "left", b.word AS "right", least(a.n, b.n) AS n FROM k JOIN c a ON a.word = substring(k.word, 1, i) JOIN c b ON b.word = substring(k.word, i + 1) WHERE a.n >= 20 AND b.n >= 20""",
    "q25_menu_layout": """WITH r AS (SELECT p_brand AS typed, p_name AS native, p_size % 6 AS tier, p_retailprice AS score, p_size % 4 AS closeness, p_size AS weight, p_partkey AS idx, (p_partkey % 10) / 10.0 AS confidence FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 24),
k AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY tier, score DESC, closeness DESC, weight DESC, idx) AS rank FROM r),
g AS (SELECT *, CASE WHEN tier <= 2 THEN 'w' WHEN tier = 3 THEN 'l' WHEN tier = 4 THEN 'p' WHEN confidence >= 0.5 THEN 's' ELSE 'e' END AS grp FROM k),
h AS (SELECT *, row_number() OVER (PARTITION BY typed, grp ORDER BY rank) AS i, count(*) FILTER (WHERE grp = 'w') OVER (PARTITION BY typed) AS words FROM g),
o AS (SELECT *, CASE WHEN grp = 'w' AND i = 1 THEN 1 WHEN grp = 'l' AND i = 1 THEN 2 WHEN grp = 'w' AND i <= 3 THEN 3 WHEN grp = 's' AND i <= 2 AND words > 0 THEN 4 WHEN grp = 'w' THEN 5
  WHEN grp = 'p' THEN 6 WHEN grp IN ('s', 'e') AND NOT (grp = 's' AND i <= 2) THEN 7 END AS slot FROM h),
z AS (SELECT typed, native, row_number() OVER (PARTITION BY typed ORDER BY slot, rank) AS pos, slot, rank FROM o WHERE slot IS NOT NULL)
SELECT r.typed, coalesce(string_agg(z.native, '|' ORDER BY pos) FILTER (WHERE pos <= 6), '') AS menu FROM (SELECT DISTINCT typed FROM r) r LEFT JOIN z USING (typed) GROUP BY r.typed""",
    "q27_learning_store": """SELECT user_id, event_type, least(count(*), 255) AS explicit_count, max(ts) AS last_used FROM events GROUP BY user_id, event_type
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) <= 8""",
}
