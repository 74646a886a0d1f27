"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two bits
differ in at most one bit of the high half, or not at all in the low half; so each one probes the
33 keys of the radius-1 ball of its high half and the one key of its low half, fetches what the
tables hold there and verifies the complete distance. Tables hold distinct fingerprints only.

A bucket that holds more than ``heavy`` fingerprints is not expanded into pairs. Everything that
lies in it or probes it emits the 65 keys of its radius-1 ball over all 64 bits: two fingerprints
share such a key exactly if they differ in at most two bits, so linking each to the smallest one
under the key keeps every component, with 65 rows a fingerprint whatever the bucket's size.

Where a similarity is asked for (``copies.near_components``), sets have wide fingerprints of 1,024
bits, as at a similarity of 0.8 about 15 % of the bits differ. They have two indexes. ``segments``
is that of the 32 segments of 32 bits. ``crossing`` holds TABLES tables, each keyed by KEY bits drawn
from all (the permuted tables of one fingerprint); who shares a key is compared on CHECK words in the
bucket. ``within`` verifies the complete distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarkash.llm.common import cut
from tarkash.llm.components import components

LOW = 0xFFFFFFFF
FEW = 1_000_000  # ids of 8 bytes that are broadcast
WORDS, RADIUS = 16, 222  # of a wide fingerprint; at a similarity of 0.8 its distance is 155 +- 11.5
TABLES, KEY = 192, 13
CHECK, CHECK_RADIUS = 3, 58  # the first words, compared in a bucket: 29.1 +- 5.0 bits at 0.8
HEAVY, MANY = 4096, 1  # members of a bucket that is compared; pairs a member that are told
CELL = 1 << 20  # fingerprints of a table that one task reads


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as a signed 64-bit integer; 0 for a text without words."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(whole, np.uint8) == 32), len(whole))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :]
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        stops = last[k : k + 65536].tolist()
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts[k : k + len(stops)].tolist(), stops, strict=True)], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (signed 64-bit) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def wide_fingerprint(held, seed: int = 42):
    """The SimHash of a set of shingle hashes as WORDS signed 64-bit integers; a bit is 1 if set in over half of them."""
    import numpy as np

    draw = np.random.default_rng(seed)
    factor, plus = draw.integers(0, 1 << 63, (2, WORDS), dtype=np.uint64)
    hashes, votes = np.asarray(held).view(np.uint64), np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(hashes), 255):  # 255 votes fit a byte
        x = hashes[k : k + 255, None] * (factor | np.uint64(1)) + plus
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        votes += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)


def within(x: str, y: str, radius: int = RADIUS) -> Column:
    """Whether two wide fingerprints (arrays) differ in at most ``radius`` bits."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k) <= radius


def segments(prints: DataFrame) -> DataFrame:
    """node, n and key of each 32-bit segment of ``prints(node, n, print)``."""
    halves = lambda w, i: F.array(F.shiftrightunsigned(w, 32) + i * (1 << 33), w.bitwiseAND(F.lit(LOW).cast("long")) + i * (1 << 33) + (1 << 32))
    return prints.select("node", "n", F.explode(F.flatten(F.transform("print", lambda w, i: halves(w, i.cast("long"))))).alias("key"))


def _wide(column: pa.Array):
    """An array column of wide fingerprints as a matrix."""
    import numpy as np

    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, WORDS)


def _columns(seed: int):
    """The bits that key each table."""
    import numpy as np

    draw = np.random.default_rng(seed)
    return np.array([draw.choice(64 * WORDS, KEY, replace=False) for _ in range(TABLES)])


def bucket_pairs(key, n, c, words, similarity: float):
    """(a, b, full): places of the pairs of one key and different c within CHECK_RADIUS, and of members told instead.

    Sets of sizes ``n`` too far apart for the similarity are no pair.
    A bucket of over HEAVY members is not compared and one of over MANY pairs a member does not tell
    them: their members of several c are ``full``.
    """
    import numpy as np

    order = np.argsort(key, kind="stable")
    key, n, c, words = key[order], n[order], c[order], words[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    bucket, place = np.repeat(np.arange(len(starts)), sizes), np.arange(len(key)) - np.repeat(starts, sizes)
    after = np.repeat(sizes, sizes) - place - 1
    several = np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts)
    heavy = several & (sizes > HEAVY)
    alive, found, far = np.flatnonzero((several & ~heavy)[bucket] & (after > 0)), [], 1
    while len(alive):
        other = alive + far
        fit = (c[alive] != c[other]) & (np.minimum(n[alive], n[other]) >= similarity * np.maximum(n[alive], n[other]) - 1e-6)
        x, y = alive[fit], other[fit]
        near = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int32) <= CHECK_RADIUS
        found.append(np.stack([x[near], y[near]]))
        far += 1
        alive = alive[after[alive] >= far]
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    crowded = np.bincount(bucket[a], minlength=len(starts)) > MANY * sizes
    full = np.union1d(np.flatnonzero(heavy[bucket]), np.concatenate([x[crowded[bucket[x]]] for x in (a, b)]))
    told = ~crowded[bucket[a]]
    return order[a[told]], order[b[told]], order[full]


def crossing(prints: DataFrame, rows: int, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """a and b: pairs of ``prints(node, n, print, c)`` of different c that share a key of a table and fit by size and CHECK words.

    b is null for a node whose pairs of a bucket are too many to tell (see ``bucket_pairs``). Pairs
    repeat, one table a time. A task reads a table, or of over CELL ``rows`` a part of its keys.
    """
    import numpy as np

    parts = max(0, min(KEY, (rows // CELL).bit_length()))  # leading bits of the key

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, weights = _columns(seed), 1 << np.arange(KEY)
        for batch in batches:
            if not batch.num_rows:
                continue
            node, n, wide, c = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _wide(batch.column(2)), batch.column(3).to_numpy()
            bits, c = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little"), c ^ node  # mostly zero, which compresses
            for t in range(TABLES):
                key = bits[:, columns[t]] @ weights
                cell = key >> (KEY - parts)
                out = []
                for k in np.unique(cell).tolist():
                    i = np.flatnonzero(cell == k)
                    out.append(((t << parts) + k, *(x[i].tobytes() for x in (key.astype(np.uint16), node, n, c, wide[:, :CHECK]))))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], ["cell", "key", "node", "n", "c", "words"])

    def compare(cell: pa.Table) -> pa.Table:
        key, node, n, c, words = (np.frombuffer(b"".join(cell.column(k).to_pylist()), d) for k, d in (("key", np.uint16), ("node", np.int64), ("n", np.int32), ("c", np.int64), ("words", np.uint64)))
        a, b, full = bucket_pairs(key, n, c ^ node, words.reshape(-1, CHECK), similarity)
        x, y = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        return pa.table({"a": pa.array(np.concatenate([x, node[full]]), pa.int64()), "b": pa.concat_arrays([pa.array(y, pa.int64()), pa.nulls(len(full), pa.int64())])})

    cells = prints.select("node", F.col("n").cast("int").alias("n"), "print", "c").mapInArrow(index, "cell int, key binary, node binary, n binary, c binary, words binary")
    return cells.groupBy("cell").applyInArrow(compare, "a long, b long")


def _flips(bits: range) -> list[Column]:
    # the sign bit as a literal that fits a long
    return [F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in bits)]


def _far(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def links(distinct: DataFrame, heavy: int = 64) -> DataFrame:
    """Pairs (a, b) of fingerprints at distance 1 or 2 whose graph has the components of all such pairs."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(LOW).cast("long"))
    table = distinct.select("fp", F.explode(F.array(F.struct(F.lit(1).alias("t"), high.alias("key")), F.struct(F.lit(2).alias("t"), low.alias("key")))).alias("x")).select("fp", "x.t", "x.key")
    ball = F.transform(F.array(*_flips(range(32))), lambda m: F.struct(F.lit(1).alias("t"), high.bitwiseXOR(m).alias("key")))
    probes = distinct.select("fp", F.explode(F.array_append(ball, F.struct(F.lit(2).alias("t"), low.alias("key")))).alias("x")).select(F.col("fp").alias("a"), "x.t", "x.key")
    big = cut(table.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("t", "key"))
    some = not big.isEmpty()
    rest = table.join(big, ["t", "key"], "left_anti") if some else table
    found = probes.join(rest.withColumnRenamed("fp", "b"), ["t", "key"]).where("a < b").where(_far("a", "b") <= 2).select("a", "b")
    if some:
        near = probes.join(big, ["t", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()
        keys = near.select("fp", F.explode(F.transform(F.array(*_flips(range(64))), lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
        keys = cut(keys)
        hubs = keys.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
        found = found.union(keys.join(hubs, "key").where("fp <> hub").where(_far("fp", "hub") <= 2).select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct())
    return found


def simhash_components(docs: DataFrame, width: int = 3, seed: int = 42, heavy: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Rows whose fingerprints differ in at most two bits are linked; component_id is the smallest
    doc_id reachable. Equal and empty texts share a fingerprint and so a component. Repeated rows
    stay, an empty table gives none; a null doc_id stays null and is not the smallest. Other columns
    are not read.
    """
    fps = cut(fingerprints(docs, width, seed))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    graph = components(links(distinct.select("fp"), heavy))
    joined = distinct.join(graph.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    smallest = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = joined.select("fp", "c").join(smallest, "c").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, seed: int = 42, classes: Callable[[DataFrame, int, int], DataFrame] | None = None) -> DataFrame:
    """The documents that are the smallest doc_id of their component, with all columns.

    ``classes`` gives doc_id and component_id of a table for a width and a seed; without it they
    are those of ``simhash_components``. Documents without a doc_id are kept as they are. Of rows
    that repeat a kept doc_id the first by text, then by the other columns, stays. An empty table
    gives none. Only ids and, where doc_ids repeat, those rows are shuffled: the texts stay where
    they are while the dropped ids are few enough to broadcast (``few``).
    """
    known = docs.where("doc_id is not null")
    found = cut((classes or simhash_components)(known, width, seed))
    rest = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("component_id").alias("c"))
    gone, again = rest.where("c <> doc_id").select("doc_id"), rest.where("c = doc_id and n > 1").select("doc_id")
    few = lambda side: F.broadcast(side) if side.count() <= FEW else side
    gone, again = cut(gone), cut(again)
    row = F.struct(F.col("text").alias("t"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = known.join(few(gone), "doc_id", "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.where("doc_id is null").select(*columns).union(kept.join(few(again), "doc_id", "left_anti").select(*columns))
    if not again.isEmpty():
        first = kept.join(few(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("r"))
        out = out.union(first.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
    return out
