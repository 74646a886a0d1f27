"""Approximate nearest neighbours by collision counting (query-aware hashing).

Each hash is one projection, kept as an array sorted once for every shard of rows. A query opens a
window centred on its own projection in every array; virtual rehashing widens all windows by a
ratio. Vectors that fall into the windows of a share of the projections are verified with exact
distances. The directions come in orthonormal sets, so that the number of collisions tells a
distance apart from a longer one better than independent directions would.

A first pass widens the windows of each shard until ``seeds`` vectors have been verified; the k-th
distance over all shards is the query's radius. The second pass opens the windows of that radius at
once and verifies every vector over the threshold, so a query ends on the whole table's k-th
distance and not on a shard's.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.llm.common import release, stored
from tarkash.llm.vectors import Arrays, Shards, best


def directions(size: int, projections: int, seed: int) -> np.ndarray:
    """size x projections: orthonormal sets of directions, scaled like independent normal ones."""
    rng, sets = np.random.default_rng(seed), []
    while sum(s.shape[1] for s in sets) < projections:
        sets.append(np.linalg.qr(rng.standard_normal((size, size)))[0] * sqrt(size))
    return np.concatenate(sets, axis=1)[:, :projections]


def index(size: int, part: Arrays, projections: int, seed: int) -> Arrays:
    """The sorted array of each projection: values, places of the rows, and each row's rank."""
    onto = (part["points"] @ directions(size, projections, seed)).T
    order = np.argsort(onto, axis=1, kind="stable")
    kind = np.uint16 if onto.shape[1] < 65536 else np.uint32
    rank = np.empty(onto.shape, kind)
    np.put_along_axis(rank, order, np.arange(onto.shape[1], dtype=kind)[None, :], axis=1)
    return part | {"sorted": np.take_along_axis(onto, order, axis=1), "order": order.astype(kind), "rank": rank}


class Windows:
    """One query's windows in a shard, and how many of them each row has fallen into."""

    def __init__(self, held: Arrays, at: np.ndarray) -> None:
        self.held, self.at = held, at
        self.n = held["rank"].shape[1]

    def counts(self, half: float) -> np.ndarray:
        """Collisions of every row with windows of this half width.

        Narrow windows are read from the sorted arrays; for wide ones the rows' ranks are compared
        with the windows' ends. Both give the same counts.
        """
        lists, m = self.held["sorted"], len(self.at)
        ends = np.empty((2, m), np.int64)
        for j in range(m):
            ends[:, j] = lists[j].searchsorted((self.at[j] - half, self.at[j] + half))
        a, b = ends
        total = int((b - a).sum())
        if total * 16 < self.n * m:
            inside = [self.held["order"][j, a[j] : b[j]] for j in np.flatnonzero(b > a)]
            return np.bincount(np.concatenate(inside), minlength=self.n) if inside else np.zeros(self.n, np.int64)
        rank = self.held["rank"]
        kind, most = rank.dtype, np.iinfo(rank.dtype).max
        some = b > a
        inside = rank - a.astype(kind)[:, None] < np.minimum(b - a, most).astype(kind)[:, None]  # wraps below a window's start
        full = (b - a) > most
        if full.any():
            inside[full] = True
        return inside[some].sum(axis=0, dtype=np.uint16 if m < 65536 else np.int64)


def _distances(held: Arrays, places: np.ndarray, vector: np.ndarray) -> np.ndarray:
    gap = held["points"][places] - vector
    return np.sqrt((gap * gap).sum(axis=1))


def search(held: Arrays, asked: Arrays, limit: np.ndarray, k: int, threshold: float, width: float, ratio: float, seeds: int, line: np.ndarray) -> list:
    """(query's place, rows' places, distances) of the k best rows verified for each query of a group.

    A query with a limit opens the windows of that radius; one without widens them from a narrow
    start until ``seeds`` rows have been verified, those with most collisions first.
    """
    onto, out = asked["points"] @ line, []
    n, m = held["rank"].shape[1], line.shape[1]
    need, spread = int(np.ceil(threshold * m)), float(np.median(np.abs(held["sorted"]))) or 1.0
    widest = float(np.abs(held["sorted"][:, [0, -1]]).max()) + 1.0
    for i in range(len(onto)):
        windows, own = Windows(held, onto[i]), held["rows"] == asked["rows"][i]
        slack = 1e-9 * (widest + float(np.abs(onto[i]).max()))
        radius = limit[i] if limit[i] == limit[i] else None
        if radius is not None:
            hit = np.flatnonzero((windows.counts(width * radius + slack) >= need) & ~own)
        else:
            radius, hit, wanted = spread / 8, np.empty(0, np.int64), min(seeds, n - int(own.sum()))
            while len(hit) < wanted:
                counts = windows.counts(width * radius + slack)
                counts[own] = 0
                hit = np.flatnonzero(counts >= need)
                if width * radius > 2 * (widest + float(np.abs(onto[i]).max())):
                    hit = np.flatnonzero(~own)
                radius *= ratio
            if len(hit) > wanted:
                hit = hit[np.argsort(-counts[hit].astype(np.int64), kind="stable")[:wanted]]
        gap = _distances(held, hit, asked["points"][i])
        first = np.lexsort((held["rows"][hit], held["ids"][hit], gap))[:k]
        out.append((i, hit[first], gap[first]))
    return out


def nearest(
    vectors: DataFrame, every: int = 100, k: int = 10, projections: int = 128, margin: float = 0.03, ratio: float = 1.5, width: float = 1.0, seeds: int = 40, seed: int = 7, shard_rows: int = 8192, group_rows: int = 8192
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of each query's k nearest found.

    Queries are the rows whose vec_id is divisible by ``every``; every other row is a candidate, also
    one that repeats the query's vec_id, and each row that repeats a query's vec_id asks for itself. ``width`` is the half window over the
    radius; a row is verified if it collides in a share of the projections that a row at the
    radius reaches on average, less ``margin``. Vectors that are null, zero, or hold a null or
    non-finite component take no part; vectors of another length than the query's are no
    candidates. Ties go to the smaller vec_id, an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    threshold = erf(width / sqrt(2)) - margin

    def shape(size: int, part: Arrays) -> Arrays:
        return index(size, part, projections, seed) if size else part | {"rank": np.zeros((0, len(part["rows"])), np.uint16)}

    def run(held: Arrays, asked: Arrays, limit: np.ndarray, same: bool) -> list:
        if not same or not held["points"].shape[1]:
            return []
        line = directions(held["points"].shape[1], projections, seed)
        return search(held, asked, limit, k, threshold, width, ratio, seeds, line)

    shards = Shards(vectors, every, False, shape, shard_rows, group_rows)
    order = F.col("score").asc()
    first, _ = stored(shards.visit(run, "double", 0, shards.shards, None))
    shards.limit(first, k, "first", order)
    second = stored(shards.visit(run, "double", 0, shards.shards, "first"))[0]
    release(shards.uri)
    both = first.union(second).dropDuplicates(["query", "row"])
    return best(both, k, order).select("query_id", "rank", "vec_id", "score")
