"""What the two vector searches share: rows dealt once to shards, queries to groups, and passes over both.

A shard holds the index of a bounded number of rows, a group a bounded number of queries; both are
files in the folder the cluster shares, built once and mapped by the workers. A pass visits every
shard with every group, so neither rows nor queries are shuffled again, and what one pass finds
gives each query a limit for the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.llm.common import mapped, put, release, shared_dir, stored
from tarkash.llm.eliasfano import dump, load

FOUND = "query long, query_id long, row long, vec_id long, score "
Arrays = dict[str, np.ndarray]


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(row, vec_id, v array<double>) of rows that take part: no null, no non-finite component, zero only if allowed.

    ``row`` tells rows apart that share a vec_id; it is fixed once the frame is stored.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    out = out if zero else out.where(F.exists("v", lambda x: x != 0))
    return out.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def of_size(data: pd.DataFrame) -> Iterator[tuple[int, Arrays]]:
    """(length, rows, ids and points) of the vectors of each length, in the order of rows."""
    for size, part in data.sort_values("row").groupby(data["v"].map(len)):
        points = np.array(part["v"].to_list(), np.float64).reshape(len(part), int(size))
        yield int(size), {"rows": part["row"].to_numpy(np.int64), "ids": part["vec_id"].to_numpy(np.int64), "points": points}


class Shards:
    """The files of one search: ``s-k`` the shards, ``q-g`` the groups of queries, ``t-p-g`` their limits after pass p."""

    def __init__(self, vectors: DataFrame, every: int, zero: bool, index: Callable[[int, Arrays], Arrays], shard_rows: int, group_rows: int) -> None:
        self.spark = vectors.sparkSession
        rows, path = stored(usable(vectors, zero))
        asks = F.col("vec_id") % every == 0
        n, q = rows.agg(F.count("*"), F.count_if(asks)).first()
        self.uri, self.shards, self.groups = shared_dir(self.spark), max(1, -(-n // shard_rows)), max(1, -(-q // group_rows))
        uri = self.uri

        def write(kind: str, shape: Callable[[int, Arrays], Arrays]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
            def one(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
                arrays, sizes = {}, []
                for size, part in of_size(data):
                    held = shape(size, part)
                    sizes.append([size, {k: a.shape for k, a in held.items()}])
                    arrays |= {f"{size}.{k}": a.ravel() for k, a in held.items()}
                put(uri, f"{kind}-{int(key[0])}", dump(arrays, {"sizes": sizes}))
                return pd.DataFrame({"n": [len(data)]})

            return one

        for kind, part, many, shape in (("s", rows, self.shards, index), ("q", rows.where(asks), self.groups, lambda _, held: held)):
            part.withColumn("part", dealt(many)).groupBy("part").applyInPandas(write(kind, shape), "n long").count()
        release(path)

    def visit(self, run: Callable[[Arrays, Arrays, np.ndarray], list], score: str, first: int, last: int, limits: str | None) -> DataFrame:
        """What ``run(shard, queries, limit)`` finds in the shards first..last-1, each with every group.

        ``run`` sees vectors of one length at a time and returns (places of queries, places of
        rows, scores); ``limits`` names a pass whose limits the queries have, else they are NaN.
        """
        uri, groups = self.uri, self.groups
        kind = pa.float64() if score == "double" else pa.int64()

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    s, g = divmod(task, groups)
                    yield from _meet(opened(uri, f"s-{s}"), opened(uri, f"q-{g}"), _limits(uri, f"t-{limits}-{g}") if limits else None, run, kind)

        tasks = (last - first) * groups
        return self.spark.range(first * groups, last * groups, 1, max(1, min(tasks, 10_000))).mapInArrow(go, FOUND + score)

    def limit(self, found: DataFrame, k: int, name: str, order: Column) -> None:
        """Writes the k-th score of every query that has one as its limit."""
        uri = self.uri

        def write(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
            data = data.sort_values("query")
            put(uri, f"t-{name}-{int(key[0])}", dump({"query": data["query"].to_numpy(np.int64), "score": data["score"].to_numpy()}, {}))
            return pd.DataFrame({"n": [len(data)]})

        last = best(found, k, order).where(F.col("rank") == k).select(F.col("query").alias("row"), "query", "score")
        last.withColumn("part", dealt(self.groups)).groupBy("part").applyInPandas(write, "n long").count()


def dealt(many: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(many))


def opened(uri: str, name: str) -> dict[int, Arrays]:
    """length -> arrays of a shard or group; empty if it has no file."""
    data = mapped(uri, name)
    if data is None:
        return {}
    arrays, facts = load(data)
    return {size: {k: arrays[f"{size}.{k}"].reshape(shape) for k, shape in held.items()} for size, held in facts["sizes"]}


def _limits(uri: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    data = mapped(uri, name)
    arrays = load(data)[0] if data is not None else {"query": np.empty(0, np.int64), "score": np.empty(0)}
    return arrays["query"], arrays["score"]


def _meet(shard: dict, group: dict, limits: tuple | None, run: Callable, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for size, asked in group.items():
        for held_size, held in shard.items():
            limit = np.full(len(asked["rows"]), np.nan)
            if limits is not None and len(limits[0]):
                at = np.minimum(np.searchsorted(limits[0], asked["rows"]), len(limits[0]) - 1)
                limit = np.where(limits[0][at] == asked["rows"], limits[1][at], np.nan)
            parts = [x for x in run(held, asked, limit, held_size == size) if len(x[1])]
            if parts:
                q = np.concatenate([np.full(len(i), a) for a, i, _ in parts])
                i = np.concatenate([i for _, i, _ in parts])
                columns = [asked["rows"][q], asked["ids"][q], held["rows"][i], held["ids"][i]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.concatenate([s for _, _, s in parts]), kind)], ["query", "query_id", "row", "vec_id", "score"])


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The k best of each query with ``rank``; ties go to the smaller vec_id, then to the earlier row."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(order, "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
