"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, HOST, LINES, DROPPED = "__tk_text", "__tk_host", "__tk_lines", "__tk_dropped"
FEW = 200_000  # lines of 16 bytes, or hosts, that are broadcast


def after_scheme(url: Column) -> Column:
    """What follows the first ://, empty without one; null stays null."""
    return F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)


def host_of(url: Column) -> Column:
    """What follows the first ://, up to /, ?, # or the end, with A-Z lower-cased; empty without it."""
    host = F.regexp_extract(after_scheme(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def html_lines(html: Column) -> Column:
    """The page's text with a line for each block: scripts, styles, comments and tags go."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    blocks = F.regexp_replace(bare, r"(?is)<(?:br|/p|/div|/li|/h[1-6]|/td|/tr|/title|/article|/nav)[^>]*>", "\n")
    return F.regexp_replace(blocks, r"(?s)<[^>]*>", "")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def site_lines(docs: DataFrame, text: Column, host: Column, ratio: float = 0.5, least_held: int = 3, few: int = FEW) -> DataFrame:
    """All columns of ``docs`` and __tk_text (what stays of the text), __tk_host, __tk_lines, __tk_dropped.

    A line is a stretch between line feeds without its outer blanks and tabs. For each host, the
    pages that contain a line are divided by the host's pages; a line over ``ratio`` goes wherever
    it stands on that host, if it is on ``least_held`` pages at least: one or two pages of a small
    host show no habit. Blank lines are counted in __tk_lines, but never go. A null text counts as
    empty, a null host as the empty host, repeated rows as pages of their own; an empty table gives
    none. A column of ``docs`` with a result's name stays, and the result's name gets underscores.

    A host has under (mean lines a page) / ratio such lines, so each host's set is small however
    many pages it has. Counts are added up before the shuffle. Up to ``few`` such lines are
    broadcast and no text is shuffled; beyond, pages meet them by host and a salt.
    """
    from tarkash.llm.common import cut, free_name, packed_row, unpacked_row, with_side

    rows = docs.select(packed_row(docs).alias("row"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.filter(F.transform(F.split("text", "\n", -1), _trimmed), lambda x: x != "")
    held = rows.select("host", F.explode(F.array_distinct(F.transform(lines, _key))).alias("key"))
    counts = cut(held.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least_held))
    totals = cut(totals)
    common = with_side(counts, totals, ["host"], totals.count() <= few, F.col("key")).where(F.col("n") > F.col("pages") * F.lit(float(ratio)))
    common = cut(common.groupBy("host").agg(F.collect_set("key").alias("common")))
    size = common.agg(F.coalesce(F.sum(F.size("common")), F.lit(0))).first()[0]
    marked = with_side(rows, common, ["host"], size <= few, F.col("text"), "left")
    all_lines = F.split("text", "\n", -1)
    stay = F.filter(all_lines, lambda x: (_trimmed(x) == "") | ~F.array_contains("common", _key(_trimmed(x))))
    has = F.col("common").isNotNull()
    results = {
        HOST: F.col("host"),
        TEXT: F.when(has, F.array_join(stay, "\n")).otherwise(F.col("text")),
        LINES: F.size(all_lines),
        DROPPED: F.when(has, F.size(all_lines) - F.size(stay)).otherwise(F.lit(0)),
    }
    return marked.select(*unpacked_row(docs, "row"), *[c.alias(free_name(docs, k)) for k, c in results.items()])


ORACLE = r"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'gis'),
      '<(?:br|/p|/div|/li|/h[1-6]|/td|/tr|/title|/article|/nav)[^>]*>', chr(10), 'gis'), '<[^>]*>', '', 'gs') AS body
  FROM pages),
l AS (
  SELECT page_id, host, list_transform(string_split(body, chr(10)), lambda x: x) AS parts FROM p),
e AS (
  SELECT page_id, host, i, parts[i] AS line, trim(parts[i], ' ' || chr(9) || chr(13)) AS k
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM l)),
c AS (
  SELECT host, k, count(DISTINCT page_id) AS n FROM e WHERE k <> '' GROUP BY ALL),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY ALL),
b AS (SELECT c.host, c.k FROM c JOIN t USING (host) WHERE c.n >= {held} AND c.n > t.pages * {ratio})
SELECT e.page_id, e.host, count(*)::INT AS n_lines, count(b.k)::INT AS n_dropped,
  coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE b.k IS NULL), '') AS text
FROM e LEFT JOIN b ON e.host = b.host AND e.k = b.k GROUP BY e.page_id, e.host
"""
