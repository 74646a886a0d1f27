"""The registered queries of the training-data operators and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.llm import lines, maxscore, mixing, neighbours, pieces, pii, simhash, toxicity, trie, urls
from tarkash.llm.common import read, remainder

TOKENIZER = "piece_bpe_32k.model"
LINE_RATIO, LINE_HELD = 0.1, 3
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SPAM_WORDS = ("spam", "pills", "casino", "adult", "bets", "ads")
DOMAIN_SQL = "CASE WHEN try_cast(regexp_extract(source, '(\\d+)', 1) AS BIGINT) % 2 = 0 THEN 'web' ELSE 'core' END"
WEIGHTS = {("core",): 3, ("web",): 2, ("*", "en"): 5, ("*", "de"): 2, ("*", "fr"): 2, ("core", "es"): 4, ("web", "en", "src0"): 3}
SHARE, EPOCHS, SEED = 0.5, 3, 17


def tokenizer(name: str = TOKENIZER) -> bytes:
    """The vocabulary file's bytes (half a megabyte); it is shipped with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def domain():
    """Two domains by the number in the source's name: even is web, all else core."""
    return F.when(F.regexp_extract("source", r"(\d+)", 1).try_cast("bigint") % 2 == 0, "web").otherwise("core")


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.language_model_scores(read(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read(spark, sf_dir, "documents"), tokenizer(), keep=False)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op4_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scorer = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    held = (remainder("doc_id", 3) == 1).alias("held_out")
    return toxicity.toxicity(docs.select("doc_id", "text"), scorer).select("doc_id", held, F.col("__tk_score").alias("score"), F.col("__tk_toxic").alias("predicted"))


def op7_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    out = lines.site_lines(pages.select("page_id", "url", "html"), lines.html_lines(F.col("html")), lines.host_of(F.col("url")), LINE_RATIO, LINE_HELD)
    return out.select("page_id", F.col(lines.HOST).alias("host"), F.col(lines.LINES).alias("n_lines"), F.col(lines.DROPPED).alias("n_dropped"), F.col(lines.TEXT).alias("text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), domain(), WEIGHTS, SHARE, EPOCHS, SEED)
    names = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    return out.select("doc_id", F.col("__tk_domain").alias("domain"), *names, F.col("__tk_tokens").alias("tokens"), F.col("__tk_copies").alias("copies"), F.col("__tk_grant").alias("grant_tokens"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_products(read(spark, sf_dir, "embeddings"))


def op10_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, urls.weak_labels(pages, SPAM_WORDS))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


MAXSCORE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.z, c.z)::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_trie, op2_pieces, op3_personal_data, op4_collision_counting, op5_simhash, op6_toxicity, op7_site_lines, op8_mixing, op9_maxscore, op10_url_trees, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_site_lines": lines.ORACLE.replace("{held}", str(LINE_HELD)).replace("{ratio}", str(LINE_RATIO)),
        "op8_mixing": mixing.oracle(DOMAIN_SQL, WEIGHTS, SHARE, EPOCHS, SEED),
        "op9_maxscore": MAXSCORE_SQL,
    }
