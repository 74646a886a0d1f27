"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.llm.common import release, stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; component is the smallest reachable node.

    Large-star joins each node's larger neighbours to its smallest neighbour, small-star the
    smaller ones; the two alternate until nothing changes, about log(n) rounds. A node's
    neighbours are never gathered: both steps are a minimum per node and a join. Each round is
    written to the shared folder, so a lost executor costs one round. Links to itself are dropped;
    no links give no rows. Not converging within ``most_rounds`` raises RuntimeError.
    """
    edges, path = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        old = path
        edges, path = stored(small.where("a <> b").distinct())
        release(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = now
    raise RuntimeError("components did not converge")
