"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("__tk_domain", "__tk_lang", "__tk_source")
FEW_LEAVES = 100_000  # that are broadcast
STEP, SHORT = 3, 4096  # hex digits a narrowing step, and rows of a leaf that one task may put in order


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: int, weights: dict[tuple, int]) -> Column:
    """The integer weight of a node; a node without one has 1."""
    out = F.lit(1)
    for path, w in weights.items():
        if len(path) == level + 1:
            fits = F.lit(True)
            for column, name in zip(LEVELS, path, strict=False):
                fits = fits & ((F.col(column) == name) if name != "*" else F.lit(True))
            out = F.when(fits, F.lit(int(w))).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], level: int, weights: dict[tuple, int]) -> DataFrame:
    """Adds ``grant`` to nodes with ``budget`` (the parent's) and ``cap``.

    All of a parent's children get the same tokens a weight, but none more than its cap, and what
    a short child leaves goes to its siblings. Sorted by cap a weight, the common rate is the
    largest of (budget - caps before) / (weights from here on).
    """
    name = LEVELS[level]
    nodes = nodes.withColumn("w", _weight(level, weights))
    short = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(-1.0), name)
    before = short.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    usable = F.when(F.col("w") > 0, F.col("cap")).otherwise(0)
    nodes = nodes.withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    nodes = nodes.withColumn("rest", F.col("budget") - F.coalesce(F.sum(usable).over(before), F.lit(0)))
    nodes = nodes.withColumn("rate", F.when(F.col("rest_w") > 0, F.col("rest") / F.col("rest_w")).otherwise(0.0))
    rate = F.max("rate").over(every)
    return nodes.withColumn("grant", F.when(F.col("w") > 0, F.least(F.col("cap").cast("double"), F.floor(F.col("w") * rate).cast("double")).cast("long")).otherwise(F.lit(0).cast("long"))).drop("w", "rest_w", "rest", "rate")


def budgets(leaves: DataFrame, weights: dict[tuple, int], share: float, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with ``grant``: the tokens each leaf is to give.

    The total is ``share`` of all tokens. Budgets go down the tree by integer weights; a node can
    give ``max_epochs`` times what its leaves hold. A shortage is made up by siblings first and
    reaches an ancestor's siblings only when the whole node is short, as a node's cap is the sum of
    its leaves' caps. Grants are rounded down to whole tokens at each level.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(share))).alias("budget"))
    top = leaves.groupBy(LEVELS[0]).agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(total))  # one row
    top = _share(top.withColumn("__tk_root", F.lit(0)), ["__tk_root"], 0, weights).select(LEVELS[0], F.col("grant").alias("budget"))
    middle = leaves.groupBy(*LEVELS[:2]).agg(F.sum("cap").alias("cap")).join(top, LEVELS[0])
    middle = _share(middle, [LEVELS[0]], 1, weights).select(*LEVELS[:2], F.col("grant").alias("budget"))
    return _share(leaves.join(middle, list(LEVELS[:2])), list(LEVELS[:2]), 2, weights).drop("budget", "cap")


def _ends(stretches: DataFrame, extra: list[str]) -> DataFrame:
    """For each leaf, the first stretch of the order in which its rest ends, and the tokens before it."""
    upto = Window.partitionBy(*LEVELS).orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    ends = stretches.withColumn("upto", F.sum("t").over(upto) + F.col("before")).where(F.col("upto") > F.col("__tk_rest"))
    first = F.min(F.struct("stretch", (F.col("upto") - F.col("t")).alias("before"), "n")).alias("e")
    return ends.groupBy(*LEVELS, *extra).agg(first).select(*LEVELS, *extra, F.col("e.stretch").alias("stretch"), F.col("e.before").alias("before"), F.col("e.n").alias("n"))


def mix(docs: DataFrame, domain: Column, weights: dict[tuple, int], share: float = 0.5, max_epochs: int = 3, seed: int = 17, short: int = SHORT) -> DataFrame:
    """The selected rows with all columns of ``docs`` and __tk_domain, __tk_tokens, __tk_copies, __tk_grant.

    A leaf gives whole epochs first; the rest comes from the next epoch, whose order is the md5 of
    seed, epoch and doc_id: the longest prefix that fits. No leaf is sorted: tokens are summed in
    4,096 stretches of the md5, the stretch in which the rest ends is divided again, and so on until
    it holds at most ``short`` rows, of which only keys are put in order. What that gives is one
    key a leaf, where its prefix ends. Null domain, lang or source is the node named by the empty
    text; a null text or one without words has no tokens and comes with the place it has in the
    order. Rows that repeat a doc_id are rows of their own (in order of tokens, then md5 of the
    text); among rows that repeat all three, any may come first. No rows give none. A column of
    ``docs`` with a result's name stays, and the result's name gets underscores.
    """
    from tarkash.llm.common import cut, free_name, packed_row, unpacked_row, with_side

    names = {LEVELS[0]: F.coalesce(domain, F.lit("")), LEVELS[1]: F.coalesce(F.col("lang").cast("string"), F.lit("")), LEVELS[2]: F.coalesce(F.col("source").cast("string"), F.lit(""))}
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(packed_row(docs).alias("row"), *[c.alias(k) for k, c in names.items()], F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), body.alias("body"), n_words(body).alias("tokens"))
    leaves = cut(budgets(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights, share, max_epochs))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("grant") / F.col("tokens"))).otherwise(0).cast("int")
    leaves = leaves.select(*LEVELS, F.col("grant").alias("__tk_grant"), full.alias("__tk_full"), (F.col("grant") - full * F.col("tokens")).alias("__tk_rest"))
    few = leaves.count() <= FEW_LEAVES
    levels = list(LEVELS)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__tk_full").cast("string"), "id").cast("binary"))

    def keyed(side: DataFrame) -> DataFrame:
        return with_side(rows, side, levels, few, F.col("id")).withColumn("key", key)

    digits = STEP
    sums = keyed(leaves).groupBy(*levels, "__tk_rest", F.substring("key", 1, STEP).alias("stretch")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    ends = cut(_ends(sums.withColumn("before", F.lit(0).cast("long")), ["__tk_rest"]))
    narrow = keyed(leaves.drop("__tk_rest").join(ends.withColumnRenamed("stretch", "end"), levels)).where(F.substring("key", 1, STEP) == F.col("end"))
    narrow = cut(narrow.select(*levels, "__tk_rest", "before", "key", "tokens", F.md5(F.col("body").cast("binary")).alias("digest")))
    while (ends.agg(F.max("n")).first()[0] or 0) > short and digits < 32:
        digits += STEP
        sums = narrow.groupBy(*levels, "__tk_rest", "before", F.substring("key", 1, digits).alias("stretch")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
        ends = cut(_ends(sums, ["__tk_rest"]))
        narrow = with_side(narrow.drop("before", "__tk_rest"), ends.drop("n"), levels, few, F.col("key"))
        narrow = cut(narrow.where(F.substring("key", 1, digits) == F.col("stretch")).drop("stretch"))
    # Equal rows are one row here, with their number: the first that does not wholly fit is where the prefix ends.
    equal = narrow.groupBy(*levels, "__tk_rest", "before", "key", "tokens", "digest").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*levels).orderBy("key", "tokens", "digest").rowsBetween(Window.unboundedPreceding, 0)
    equal = equal.withColumn("upto", F.col("before") + F.sum(F.col("tokens") * F.col("n")).over(order)).where(F.col("upto") > F.col("__tk_rest"))
    room = F.floor((F.col("__tk_rest") - F.col("upto") + F.col("tokens") * F.col("n")) / F.greatest("tokens", F.lit(1)))
    last = equal.groupBy(*levels).agg(F.min(F.struct("key", "tokens", "digest", room.alias("fit"))).alias("end"))
    plan = cut(leaves.join(last, levels, "left"))
    dealt = keyed(plan).withColumn("digest", F.when(F.col("key") == F.col("end.key"), F.md5(F.col("body").cast("binary"))).otherwise(""))
    here, end = F.struct("key", "tokens", "digest"), F.struct("end.key", "end.tokens", "end.digest")
    within = F.when(F.col("end").isNull() | (F.col("key") < F.col("end.key")), 1).when(F.col("key") > F.col("end.key"), 0).otherwise((here < end).cast("int"))
    at_end = F.coalesce(here == end, F.lit(False))
    if plan.agg(F.max("end.fit")).first()[0]:  # some, not all, of the equal rows at an end are taken
        some = dealt.where(at_end).withColumn("place", F.row_number().over(Window.partitionBy(*levels).orderBy("key")))
        out = dealt.where(~at_end).withColumn("copies", F.col("__tk_full") + within)
        out = out.unionByName(some.withColumn("copies", F.col("__tk_full") + (F.col("place") <= F.col("end.fit")).cast("int")).drop("place"))
    else:
        out = dealt.withColumn("copies", F.col("__tk_full") + within)
    results = {LEVELS[0]: LEVELS[0], "__tk_tokens": "tokens", "__tk_copies": "copies", "__tk_grant": "__tk_grant"}
    return out.where("copies > 0").select(*unpacked_row(docs, "row"), *[F.col(c).alias(free_name(docs, k)) for k, c in results.items()])


def _case(level: int, weights: dict[tuple, int]) -> str:
    names = ("domain", "lang", "source")
    whens = ""
    for path, w in reversed(list(weights.items())):
        if len(path) == level + 1:
            fits = " AND ".join(f"{c} = '{n}'" for c, n in zip(names, path, strict=False) if n != "*") or "TRUE"
            whens += f" WHEN {fits} THEN {int(w)}"
    return f"CASE{whens} ELSE 1 END" if whens else "1"


def oracle(domain_sql: str, weights: dict[tuple, int], share: float, max_epochs: int, seed: int, table: str = "documents") -> str:
    """The same selection in DuckDB SQL: doc_id, domain, lang, source, tokens, copies, grant_tokens."""

    def level(out: str, nodes: str, parent: str, name: str, w: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        return f"""
{out}_w AS (SELECT *, {w} AS w FROM {nodes}),
{out}_r AS (SELECT *, sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE -1.0 END, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w,
  budget - coalesce(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER ({part} ORDER BY CASE WHEN w > 0 THEN cap / w ELSE -1.0 END, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM {out}_w),
{out}_m AS (SELECT *, max(CASE WHEN rest_w > 0 THEN rest::DOUBLE / rest_w::DOUBLE ELSE 0.0 END) OVER ({part}) AS rate FROM {out}_r),
{out} AS (SELECT * EXCLUDE (w, rest_w, rest, rate, budget), CASE WHEN w > 0 THEN least(cap::DOUBLE, floor(w * rate))::BIGINT ELSE 0 END AS budget FROM {out}_m)"""

    return f"""
WITH d AS (
  SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce({domain_sql}, '') AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM {table}),
l AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {max_epochs} AS cap FROM d GROUP BY ALL),
total AS (SELECT floor(coalesce(sum(tokens), 0)::DOUBLE * {share})::BIGINT AS budget FROM l),
a0 AS (SELECT domain, sum(cap)::BIGINT AS cap, any_value(total.budget) AS budget FROM l, total GROUP BY ALL),{level("a", "a0", "", "domain", _case(0, weights))},
b0 AS (SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, any_value(a.budget) AS budget FROM l JOIN a USING (domain) GROUP BY ALL),{level("b", "b0", "domain", "lang", _case(1, weights))},
c0 AS (SELECT l.*, b.budget FROM l JOIN b USING (domain, lang)),{level("c", "c0", "domain, lang", "source", _case(2, weights))},
f AS (SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS full_epochs, tokens AS held FROM c),
o AS (SELECT d.*, f.budget, f.full_epochs, f.budget - f.full_epochs * f.held AS rest,
    md5('{seed}:' || f.full_epochs || ':' || coalesce(d.doc_id::VARCHAR, '')) AS k FROM d JOIN f USING (domain, lang, source)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, tokens, md5(coalesce(text, '')) ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT doc_id, domain, lang, source, tokens, (full_epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INT AS copies, budget AS grant_tokens
FROM s WHERE full_epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
