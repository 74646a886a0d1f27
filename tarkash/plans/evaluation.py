"""Evaluation queries, each with its SQL: latency, emoji, fingerprints, ablations, parity, tags, gates, learning and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.operators import counts, emoji, evaluation, labels, learning, metrics, splits
from tarkash.plans import evidence
from tarkash.plans.lexicon import UNIGRAMS, token_unigrams, words
from tarkash.plans.menus import EMOJI, LATIN, SCRIPT, listed, values, word_counts
from tarkash.sources.tables import table
from tarkash.streaming.selections import confirmed

GOLD = SCRIPT.replace("સ", "શ").replace("િ", "ી").replace("મ", "ં").replace("ઝ", "જ")
MEASURES = ("top1", "top3", "recall6", "mrr", "ndcg6")
SURE = {"curated_gu": 0.95, "cldr": 0.9, "legacy": 0.5}
RULES = (("top1", ">=", 0.9), ("top3", ">=", 0.1), ("mrr", "<=", 0.2), ("ndcg6", ">=", 0.99))


def _prefixed(spark: SparkSession, sf_dir: str, *order, least: int = 0) -> DataFrame:
    rows = token_unigrams(spark, sf_dir).where((F.length("word") >= 2) & (F.col("n") >= least)).withColumn("prefix", F.substring("word", 1, 2))
    return rows.withColumn("rank", F.row_number().over(evidence.Window.partitionBy("prefix").orderBy(*order)))


def _lists(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    rows = token_unigrams(spark, sf_dir).where((F.length("word") >= 2) & (F.col("n") >= least)).withColumn("prefix", F.substring("word", 1, 2))
    top = counts.top_per_key(rows, "prefix", 6, F.desc("n"), F.col("word"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    return top.groupBy("prefix").agg(listed.alias("menu"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return rows.select("event_type", "n", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"))


def emoji_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    own = word_counts(spark, sf_dir).where(n % 3 == 0).select(F.col("word").alias("code"), F.lit("🌟").alias("emoji"), (F.lit(0.8) + (n % 2) * 0.15).alias("confidence"))
    keywords = spark.createDataFrame(EMOJI, "code string, emoji string, weight int, confidence double").drop("weight").unionByName(own)
    shown = F.array_compact(F.array(F.translate("word", LATIN, SCRIPT), "word", F.when(n % 3 == 0, "🌟"), F.when(n % 7 == 0, "🙂")))
    menus = word_counts(spark, sf_dir).select(F.col("word").alias("typed"), shown.alias("menu"))
    out = evaluation.emoji_quality(menus, keywords)
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "false_positive")})


def menu_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fingerprint(_lists(spark, sf_dir).withColumnRenamed("prefix", "typed"))


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def report(*order) -> DataFrame:
        rows = _prefixed(spark, sf_dir, *order).withColumn("place", F.when(F.col("rank") <= 6, F.col("rank")))
        return metrics.ranking(rows.where("n >= 2"), "place")

    out = evaluation.ablation(report(F.desc("n"), F.col("word")), report(F.col("word")), MEASURES)
    return out.select(*[F.round(m, 6).alias(m) for m in MEASURES])


def menu_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.parity(_lists(spark, sf_dir), _lists(spark, sf_dir, 2), "prefix", "menu").groupBy("state").agg(F.count("*").alias("menus"))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir)
    test = rows.where(splits.bucket("frozen", F.col("word")) == "test")
    return evaluation.eligible(words(spark, sf_dir, "benchmark").distinct(), test, rows.where("n >= 40"), "word")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    ours, gold = F.translate("word", LATIN, SCRIPT), F.concat(F.translate("word", LATIN, GOLD), F.when(n % 5 == 0, "ું").otherwise(""))
    rows = token_unigrams(spark, sf_dir).select("word", "n", ours.alias("ours"), gold.alias("gold"))
    return rows.withColumn("menu", F.when(n % 2 == 0, F.array("ours", "gold")).otherwise(F.array("ours")))


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = evaluation.disagreement_tags(F.col("word"), F.col("ours"), F.col("gold"), F.col("n") % 3, F.col("menu"))
    return _compared(spark, sf_dir).select("word", F.array_join(tags, ",").alias("tags"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = evaluation.capture_cluster(F.col("gold"), F.col("menu"), F.col("n"))
    return _compared(spark, sf_dir).groupBy(cluster.alias("cluster")).agg(F.count("*").alias("words"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.failure_signals(F.col("word"), F.col("gold"), F.col("menu"))
    return _compared(spark, sf_dir).select("word", F.array_join(found, ",").alias("signals"), labels.skeleton(F.col("gold")).alias("skeleton"))


def gate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = token_unigrams(spark, sf_dir).where(F.length("word") >= 2).groupBy(F.substring("word", 1, 2).alias("prefix")).agg(F.min("word").alias("least"), F.max("word").alias("most"), F.count("*").alias("n"))
    rows = ends.join(_lists(spark, sf_dir), "prefix")
    found = evaluation.gate_failures(F.col("menu"), F.when(F.col("n") % 2 == 0, F.col("least")), F.array("least", "most"), F.array("most"), F.when(F.col("n") % 3 == 0, F.array("least")))
    return rows.select("prefix", F.array_join(found, ",").alias("failures"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.gates(evidence.rank_metrics(spark, sf_dir), RULES)
    return out.select("n", F.array_join("failures", ",").alias("failures"))


def learning_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    return learning.compact(learning.store(events, "user_id", "event_type", "ts"), "user_id", "last_used", 20)


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken as keys: ten in a row are one user's, 0.7 seconds apart."""
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "select").when(i % 4 == 2, "key").otherwise("commit")
    rows = table(spark, sf_dir, "events").select(
        F.floor(i / 10).cast("string").alias("user"), F.timestamp_millis(i * 700).alias("ts"), i.alias("seq"), kind.alias("kind"), F.col("event_type").alias("roman"),
        F.when(kind == "key", F.when(i % 3 == 0, "Escape").otherwise("x")).when(i % 5 == 0, "latin").otherwise("ઘર").alias("text"), F.lit("gujarati").alias("type"), (F.floor(i / 7) % 2).cast("string").alias("composition"),
    )
    return confirmed(rows).select("user", "roman", "native", F.unix_millis("ts").alias("ms"))


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, word = F.col("n"), F.col("word")
    source = F.when(n % 3 == 0, "curated_gu").when(n % 3 == 1, "cldr").otherwise("legacy")
    marks = F.explode(F.array(F.lit("🌟"), F.lit("🔵"), F.lit("‍x"), F.lit(""), F.concat(F.lit("❤"), F.substring("word", 1, 1)))).alias("emoji")
    first = word_counts(spark, sf_dir).select(word.alias("code"), marks, F.length("word").alias("weight"), source.alias("source"))
    return first.union(word_counts(spark, sf_dir).select(word, F.lit("🌟"), F.lit(99), F.lit("legacy")))


def emoji_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emoji.capped(emoji.keep_first(_keywords(spark, sf_dir), tuple(SURE)), SURE, 2).select("code", "emoji", "weight", "source", "confidence", "rank")


def emoji_natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = word_counts(spark, sf_dir).select(F.col("word").alias("roman"), F.translate("word", LATIN, SCRIPT).alias("native"))
    return emoji.by_native(emoji_keywords(spark, sf_dir), lexicon)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    text = F.concat(n.cast("string"), F.when(n % 2 == 0, "\t").otherwise("\x1f"), F.when(n % 5 == 0, "x").otherwise((n % 7).cast("string")), F.when(n % 3 == 0, "\t1").otherwise(""))
    return word_counts(spark, sf_dir).select("word", emoji.evidence_payload(text).alias("p")).select("word", "p.*")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("has"))
    kinds = F.array(*[F.lit(x) for x in ("click", "view", "purchase", "other")])
    return rows.select("user_id", F.array_join(emoji.missing(kinds, F.col("has")), ",").alias("missing"))


QUERIES = {
    "q45_gates": gates,
    "q46_failure_signals": signals,
    "q47_learning_compact": learning_compact,
    "q48_confirmed_selections": selections,
    "q49_emoji_keywords": emoji_keywords,
    "q50_latency": latency,
    "q51_emoji_quality": emoji_quality,
    "q52_menu_fingerprint": menu_fingerprint,
    "q53_ablation": ablation,
    "q54_menu_parity": menu_parity,
    "q55_held_out": held_out,
    "q56_disagreements": disagreements,
    "q57_capture_clusters": captures,
    "q58_gate_cases": gate_cases,
    "q59_emoji_natives": emoji_natives,
    "q60_evidence_payloads": payloads,
    "q61_missing_requirements": requirements,
}

C = f"WITH c AS MATERIALIZED ({UNIGRAMS})"
P = C + ", p AS MATERIALIZED (SELECT *, substr(word, 1, 2) AS prefix FROM c WHERE length(word) >= 2), l AS MATERIALIZED (SELECT prefix, list(word ORDER BY r) AS menu FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, word) AS r FROM p) WHERE r <= 6 GROUP BY prefix)"
G = C + f""", g AS MATERIALIZED (SELECT *, CASE WHEN n % 2 = 0 THEN [ours, gold] ELSE [ours] END AS menu FROM (
  SELECT word, n, translate(word, '{LATIN}', '{SCRIPT}') AS ours, translate(word, '{LATIN}', '{GOLD}') || CASE WHEN n % 5 = 0 THEN 'ું' ELSE '' END AS gold FROM c))"""
W = "WITH w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS word FROM part) GROUP BY word)"
K = (
    W
    + f""", raw AS (SELECT word AS code, unnest(['🌟', '🔵', chr(8205) || 'x', '', '❤' || substr(word, 1, 1)]) AS emoji, length(word)::INT AS weight, CASE n % 3 WHEN 0 THEN 'curated_gu' WHEN 1 THEN 'cldr' ELSE 'legacy' END AS source FROM w
  UNION ALL SELECT word, '🌟', 99, 'legacy' FROM w),
k AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY confidence DESC, weight DESC, emoji)::INT AS rank FROM (
  SELECT code, emoji, first(weight ORDER BY place, -weight, source) AS weight, first(source ORDER BY place, -weight, source) AS source, first(confidence ORDER BY place, -weight, source) AS confidence
  FROM (SELECT *, list_position({listed(SURE)}, source) AS place, CASE source {" ".join(f"WHEN '{a}' THEN {b}" for a, b in SURE.items())} END::DOUBLE AS confidence FROM raw)
  WHERE emoji <> '' AND NOT starts_with(emoji, chr(8205)) GROUP BY code, emoji)) WHERE rank <= 2)"""
)


def _tags(tests: dict[str, str], other: str) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{name}' END" for name, t in tests.items()) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN array_to_string({found}, ',') ELSE '{other}' END"


def _count(c: str, x: str) -> str:
    return f"(length({c}) - length(replace({c}, '{x}', '')))"


VOWELS = labels.VOWELS + "ંઁ"
SKELETON = "translate({}, '" + VOWELS + "', '')"
DIFFERENT = _tags(
    {
        "anusvara_n_stop": "contains(gold, 'ં') AND NOT contains(ours, 'ં') AND contains(ours, 'ન')",
        "long_a": f"{_count('gold', 'ા')} > {_count('ours', 'ા')}",
        "diphthong_ai_oi_ui": "regexp_matches(word, 'ai|ay|oi|ui|ei') AND regexp_matches(gold, '[ઈઇ]')",
        "typed_sh": "starts_with(word, 'sh') AND starts_with(gold, 'શ') AND starts_with(ours, 'સ')",
        "v_w": "contains(word, 'w') AND contains(gold, 'વ')",
        "z_j": "contains(word, 'z') AND regexp_matches(gold, '[ઝજ]')",
        "schwa_vs_conjunct": f"{_count('gold', '્')} <> {_count('ours', '્')}",
        "i_length": "(contains(gold, 'ી') AND contains(ours, 'િ')) OR (contains(gold, 'િ') AND contains(ours, 'ી'))",
        "nasal_final_u": "ends_with(gold, 'ું') AND NOT ends_with(ours, 'ું')",
        "geminate": "regexp_matches(word, 'mm|nn|tt|kk|ll') AND contains(gold, '્') AND NOT contains(ours, '્')",
        "english_loan": "regexp_matches(word, 'sch|tion|qu|ck|school|college|doctor|hospital|london')",
        "soft_lex_win": "n % 3 = 0 AND ours <> gold",
        "orthography_glue": "translate(ours, 'ંઁ્', '') = translate(gold, 'ંઁ્', '') AND ours <> gold",
    },
    "other",
)
FAILED = _tags(
    {
        "vowel_length": f"ours <> gold AND {SKELETON.format('ours')} = {SKELETON.format('gold')}",
        "aspiration": "regexp_matches(word, 'kh|gh|chh|jh|th|dh|ph|bh')",
        "dental_retroflex": "regexp_matches(word, '[tTdDnNlL]') OR regexp_matches(gold, '[ટઠડઢણળ]')",
        "nasal_anusvara": "regexp_matches(word, 'ng|ny|[nmM]') OR regexp_matches(gold, '[ંઁનમણઙઞ]')",
        "conjunct_virama": "contains(gold, '્')",
        "suffix_morphology": "regexp_matches(word, '(?:ma|maa|manthi|thi|ni|no|na|ne|nu|nun|va|vu|ta|ti|to|tu|she|sho)$')",
        "loanword_spelling": "regexp_matches(word, 'tion|sion|sch|ck|qu|oo|ee|[cqxfz]')",
    },
    "unknown",
)


def _report(order: str) -> str:
    return f"""SELECT avg((r = 1)::INT::DOUBLE) AS top1, avg((r <= 3)::INT::DOUBLE) AS top3, avg((r <= 6)::INT::DOUBLE) AS recall6, avg(CASE WHEN r <= 6 THEN 1.0 / r ELSE 0.0 END) AS mrr,
  avg(CASE WHEN r <= 6 THEN 1.0 / log2(r + 1) ELSE 0.0 END) AS ndcg6 FROM (SELECT n, row_number() OVER (PARTITION BY prefix ORDER BY {order}) AS r FROM p) WHERE n >= 2"""


ORACLE = {
    "q45_gates": "SELECT n, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN NOT ({c} {op} {x}) THEN '{c}' END" for c, op, x in RULES)
    + "], lambda x: x IS NOT NULL), ',') AS failures FROM ("
    + evidence.ORACLE["q16_rank_metrics"]
    + ")",
    "q46_failure_signals": f"{G} SELECT word, {FAILED} AS signals, {SKELETON.format('gold')} AS skeleton FROM g",
    "q47_learning_compact": f"WITH s AS ({evidence.ORACLE['q27_learning_store']}) SELECT * FROM s WHERE user_id IN (SELECT user_id FROM s GROUP BY user_id ORDER BY max(last_used) DESC, user_id LIMIT 20)",
    "q48_confirmed_selections": """
WITH e AS (SELECT (event_id // 10)::VARCHAR AS u, event_id AS i, event_id * 700 AS ms, CASE WHEN event_id % 4 = 0 THEN 'select' WHEN event_id % 4 = 2 THEN 'key' ELSE 'commit' END AS kind,
  regexp_replace(lower(event_type), '[^a-z+]', '', 'g') AS roman, CASE WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 3 = 0 THEN 'escape' ELSE 'x' END WHEN event_id % 5 = 0 THEN 'latin' ELSE 'ઘર' END AS t, (event_id // 7 % 2)::VARCHAR AS comp FROM events),
f AS (SELECT *, last_value(CASE WHEN kind = 'select' THEN comp END IGNORE NULLS) OVER (PARTITION BY u ORDER BY ms, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM e),
k AS (SELECT *, lag(kind = 'select' AND t = 'ઘર' AND roman <> '') OVER w AS valid, lag(roman) OVER w AS r0, lag(t) OVER w AS t0, lag(ms) OVER w AS m0 FROM f
  WHERE kind IN ('select', 'commit') OR (kind = 'key' AND (t = 'escape' OR comp IS DISTINCT FROM last)) WINDOW w AS (PARTITION BY u ORDER BY ms, i))
SELECT u AS user, r0 AS roman, t0 AS native, ms FROM k WHERE kind = 'commit' AND valid AND t0 = t AND ms - m0 <= 2000""",
    "q49_emoji_keywords": f"{K} SELECT code, emoji, weight, source, confidence, rank FROM k",
    "q50_latency": "SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "q51_emoji_quality": f"""{W}, k AS (SELECT code, emoji, confidence FROM {values(EMOJI, "code, emoji, weight, confidence")} UNION ALL SELECT word, '🌟', 0.8 + (n % 2) * 0.15 FROM w WHERE n % 3 = 0),
m AS (SELECT word AS typed, list_filter([translate(word, '{LATIN}', '{SCRIPT}'), word, CASE WHEN n % 3 = 0 THEN '🌟' END, CASE WHEN n % 7 = 0 THEN '🙂' END], lambda x: x IS NOT NULL) AS menu FROM w),
s AS (SELECT code, list(DISTINCT emoji) AS wanted FROM k WHERE confidence >= 0.9 GROUP BY code),
a AS (SELECT count(*) AS positive, coalesce(sum(coalesce(list_has_any(wanted, menu), FALSE)::INT), 0)::BIGINT AS visible FROM s LEFT JOIN m ON code = typed),
b AS (SELECT count(*) AS negative, coalesce(sum((list_contains(menu, '🙂') OR list_contains(menu, '🌟'))::INT), 0)::BIGINT AS wrong FROM m WHERE typed NOT IN (SELECT code FROM k))
SELECT positive, visible, round(visible / nullif(positive, 0), 6) AS recall, negative, wrong, round(wrong / nullif(negative, 0), 6) AS false_positive FROM a, b""",
    "q52_menu_fingerprint": f"""{P}, d AS (SELECT sha256(prefix || chr(9) || array_to_string(menu, chr(31))) AS d FROM l),
b AS (SELECT substr(d, 1, 3) AS b, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM d GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM b""",
    "q53_ablation": f"{P} SELECT " + ", ".join(f"round(a.{m} - b.{m}, 6) AS {m}" for m in MEASURES) + f" FROM ({_report('n DESC, word')}) a, ({_report('word')}) b",
    "q54_menu_parity": f"""{P}, l2 AS (SELECT prefix, list(word ORDER BY r) AS menu FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, word) AS r FROM p WHERE n >= 2) WHERE r <= 6 GROUP BY prefix)
SELECT CASE WHEN l2.prefix IS NULL THEN 'left_only' WHEN l.prefix IS NULL THEN 'right_only' WHEN l.menu = l2.menu THEN 'same' ELSE 'differs' END AS state, count(*) AS menus FROM l FULL JOIN l2 ON l.prefix = l2.prefix GROUP BY 1""",
    "q55_held_out": f"""{C}, b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)
SELECT word FROM b JOIN c USING (word) WHERE n < 40 AND ('0x' || substr(sha256('frozen' || chr(0) || word), 1, 8))::BIGINT / 4294967295.0 >= 0.9""",
    "q56_disagreements": f"{G} SELECT word, {DIFFERENT} || CASE WHEN gold <> '' AND NOT list_contains(menu, gold) THEN ',lexicon_miss' ELSE '' END AS tags FROM g",
    "q57_capture_clusters": f"""{G} SELECT CASE WHEN menu[1] = gold THEN 'ok_top1' WHEN NOT list_contains(menu, gold) THEN 'missing' WHEN regexp_matches(gold, '[ટડણળ]') THEN 'dental_retroflex'
  WHEN contains(gold, 'ા') AND NOT contains(ours, 'ા') THEN 'vowel_length' WHEN n > 0 AND n < 100 THEN 'soft_lost_to_stem' ELSE 'misranked' END AS cluster, count(*) AS words FROM g GROUP BY 1""",
    "q58_gate_cases": f"""{P}, e AS (SELECT prefix, min(word) AS least, max(word) AS most, count(*) AS n FROM p GROUP BY prefix)
SELECT prefix, array_to_string(list_filter([CASE WHEN n % 2 = 0 AND menu[1] <> least THEN 'top1' END, CASE WHEN NOT list_contains(menu, least) OR NOT list_contains(menu, most) THEN 'missing' END,
  CASE WHEN menu[1] = most THEN 'forbidden_top1' END, CASE WHEN n % 3 = 0 AND list_contains(menu, least) THEN 'forbidden' END], lambda x: x IS NOT NULL), ',') AS failures FROM e JOIN l USING (prefix)""",
    "q59_emoji_natives": f"""{K} SELECT native, emoji, first(weight ORDER BY confidence DESC, weight DESC) AS weight, max(confidence) AS confidence
FROM (SELECT translate(code, '{LATIN}', '{SCRIPT}') AS native, * FROM k WHERE source = 'curated_gu') GROUP BY native, emoji""",
    "q60_evidence_payloads": f"{W} SELECT word, n AS unigram, CASE WHEN n % 5 = 0 THEN 0 ELSE n % 7 END AS stem, n % 3 = 0 AS attested FROM w",
    "q61_missing_requirements": "SELECT user_id, array_to_string(list_sort(list_filter(['click', 'view', 'purchase', 'other'], lambda x: NOT list_contains(has, x))), ',') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS has FROM events GROUP BY user_id)",
}
