"""Exact top-k inner products by MaxScore over signed impact postings.

A vector's integer components are its impacts; a term is a dimension with a sign, and its posting
lists the rows with a component of that sign. A query gains from the terms that have its own sign
and loses through the others, so a bound on a row's score is the sum of the largest gains of its
terms. Terms are taken in order of that bound. While the bounds of the terms to come reach the k-th
best score, they are essential: a row not met yet may still compete and enters through a posting.
Once they stay under it, no new row enters, and those met are probed in the other terms while they
can compete. The k-th best score rises with every batch of postings, as the leading rows are scored
in full. Rows are in shards; a first wave of shards gives the k-th best score that the others start
from, and the shards' lists are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.llm.common import release, stored
from tarkash.llm.vectors import Arrays, Shards, best

BATCH = 4


def impacts(points: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(points * scale).astype(np.int64)


def index(part: Arrays, scale: int) -> Arrays:
    """The impacts by dimension, the postings of both signs one after the other, and each term's largest impact."""
    columns = np.ascontiguousarray(impacts(part["points"], scale).T)
    size, n = columns.shape
    gains, losses = (np.nonzero(columns > 0), np.nonzero(columns < 0))
    ends = [np.searchsorted(d, np.arange(size + 1)) for d, _ in (gains, losses)]
    most = np.stack([columns.max(axis=1, initial=0), -columns.min(axis=1, initial=0)]) if size and n else np.zeros((2, size), np.int64)
    return {"rows": part["rows"], "ids": part["ids"], "columns": columns, "up": gains[1].astype(np.int32), "down": losses[1].astype(np.int32), "up_ends": ends[0], "down_ends": ends[1], "most": most}


class Top:
    """The k best scores of one query so far, and the score a row must reach."""

    def __init__(self, k: int, least: int | None) -> None:
        self.k, self.least, self.scores = k, least, np.empty(0, np.int64)

    def add(self, scores: np.ndarray) -> None:
        if not len(scores):
            return
        self.scores = np.sort(np.concatenate((self.scores, scores.astype(np.int64))))[-self.k :]
        if len(self.scores) == self.k and (self.least is None or self.scores[0] > self.least):
            self.least = int(self.scores[0])


def exact(held: Arrays, vector: np.ndarray) -> np.ndarray:
    """The impacts as doubles where no sum with this query can leave their exact integers, else as they are."""
    most = np.maximum(held["most"][0], held["most"][1]).astype(np.float64)
    return held["doubles"] if float(np.abs(vector[: len(most)]) @ most[: len(vector)]) < 2**53 else held["columns"]


def traverse(held: Arrays, vector: np.ndarray, own: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of the rows that may be among the k best, and how many impacts were read.

    ``least`` is a score that k rows elsewhere reach; rows under it are left out, those that reach
    it are not. While over a quarter of the rows may compete, sums run over whole columns.
    """
    columns = exact(held, vector)
    n, weight = columns.shape[1], vector[: len(columns)].astype(columns.dtype)
    bound = np.where(weight > 0, weight * held["most"][0, : len(weight)], -weight * held["most"][1, : len(weight)])
    terms = np.flatnonzero(weight)
    terms = terms[np.lexsort((terms, -bound[terms]))]
    rest = np.concatenate((np.cumsum(bound[terms][::-1])[::-1], [0]))  # what the terms from a place on can add
    top, read = Top(k, least), 0
    met, whole = np.zeros(n, bool), own.copy()
    alive, score = None, np.zeros(n, columns.dtype)  # alive None: all rows met
    for a in range(0, len(terms), BATCH):
        batch = terms[a : a + BATCH]
        if alive is None:
            score += weight[batch] @ columns[batch]
            read += n * len(batch)
            if top.least is None or rest[a] >= top.least:  # essential: rows may enter
                for d in batch:
                    list_, ends = ("up", "up_ends") if weight[d] > 0 else ("down", "down_ends")
                    met[held[list_][held[ends][d] : held[ends][d + 1]]] = True
            may = met & ~own
        else:
            score += weight[batch] @ columns[batch].take(alive, axis=1)
            read += len(alive) * len(batch)
        left = rest[a + len(batch)]
        if alive is not None or may.any():
            places = np.flatnonzero(may) if alive is None else alive
            held_score = score[places] if alive is None else score
            lead = np.argpartition(-held_score, min(2 * k, len(places) - 1))[: 2 * k] if len(places) else places
            lead = places[lead]
            lead = lead[~whole[lead]]
            whole[lead] = True
            top.add(weight @ columns[: len(weight)].take(lead, axis=1))
            if top.least is not None:
                stay = held_score + left >= top.least
                if alive is not None or (left < top.least and np.count_nonzero(stay) * 4 < n):
                    alive, score = places[stay], held_score[stay]
    if alive is None:
        alive = np.flatnonzero(met & ~own)
        score = score[alive]
        if top.least is None or top.least <= 0:  # a row in no posting of the query may compete
            new = np.flatnonzero(~met & ~own)
            alive, score = np.concatenate((alive, new)), np.concatenate((score, weight @ columns[: len(weight)].take(new, axis=1)))
    if top.least is not None:
        alive, score = alive[score >= top.least], score[score >= top.least]
    return alive, score.astype(np.int64), read


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard_rows: int = 8192, group_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``;
    every other row is a candidate, also one that repeats the query's vec_id, and each row that
    repeats a query's vec_id asks for itself. Equal scores go to the smaller vec_id. Vectors that are null or
    hold a null or non-finite component take no part; a missing component of a shorter vector is 0.
    An empty table gives no rows. Components beyond 2**31 / scale are outside what long scores hold.
    Other columns, whatever their names, are not read.
    """

    def run(held: Arrays, asked: Arrays, limit: np.ndarray, same: bool) -> list:
        out, vectors = [], impacts(asked["points"], scale)
        held = held | {"doubles": held["columns"].astype(np.float64)}
        for i in range(len(vectors)):
            least = None if limit[i] != limit[i] else int(limit[i])
            places, scores, _ = traverse(held, vectors[i], held["rows"] == asked["rows"][i], k, least)
            first = np.lexsort((held["rows"][places], held["ids"][places], -scores))[:k]
            out.append((i, places[first], scores[first]))
        return out

    shards = Shards(vectors, every, True, lambda _, part: index(part, scale), shard_rows, group_rows)
    order, lead = F.col("score").desc(), -(-shards.shards // 16)
    found = stored(shards.visit(run, "long", 0, lead, None))[0]
    if shards.shards > lead:
        shards.limit(found, k, "first", order)
        found = found.union(stored(shards.visit(run, "long", lead, shards.shards, "first"))[0])
    release(shards.uri)
    return best(found, k, order).select("query_id", "rank", "vec_id", "score")
