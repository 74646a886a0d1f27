"""Language-model scoring with an Elias-Fano n-gram trie of a chosen order.

Level 1 holds the training words as sorted 63-bit hashes, Elias-Fano coded in shards by hash range;
a word's id is its place. Level 2 holds for each context word the words that follow it. Its shards
are cells of a grid, context ids by successor ids, so a very common context is spread over several
and a shard's size has a bound. Every further level hangs below the cell of the n-gram's first two
words: level n holds for each place of level n - 1 the words that follow it there. In a cell,
monotone pointers give each context's stretch, and the successors are stored relative to their
context, which makes the whole level one monotone sequence; a query searches for the successor only
within the context's stretch. Probabilities are absolute-discounted and interpolated down to the
smoothed word probabilities; the discounted parts and the contexts' interpolation weights are
quantised to 256 values each. Level 1 keeps counts, as exact counts of words are asked for.

Counting is one pass for words and one for all longer n-grams; counts are added up before each
shuffle and move as packed arrays. The shards are files in the folder the cluster shares. Every
worker maps them into memory, so what it holds is what it touches, not the model.

Two bounds: two different words share a hash with a probability of about words**2 * 2**-64 (1e-5
for ten million distinct words, 5 % for 1e9), and more than 2**31 distinct words raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.llm.common import mapped, put, remainder, shared_dir
from tarkash.llm.eliasfano import EliasFano, dump, load

END = b"\n"  # no word holds a line feed
ORDER = 3
DISCOUNTS = (0.75, 0.8)  # of level 2 and of all above
CHUNK = 5 << 20  # bytes of text worked on at a time
FLUSH = 1_000_000
KNOWN = 500_000
SHARD_BYTES = 32 << 20
MOST_SHARDS = 512  # 2**31 words by 4 million a shard


class Tokens:
    """The tokens of a stretch of texts: words with A-Z lower-cased between ASCII white space, and an end after each text.

    ``words`` are the distinct tokens, the end first; ``at`` the place of every token in them, and
    ``starts`` each text's first token.
    """

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = lists.flatten().cast(pa.large_binary())
        ends = np.asarray(lists.offsets)[1:].astype(np.int64) - lists.offsets[0].as_py()
        full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))  # outer white space leaves empty words
        if not full.all():
            flat = flat.filter(pa.array(full))
            ends = np.concatenate(([0], np.cumsum(full)))[ends]
        coded = flat.dictionary_encode()
        self.words: list[bytes] = [END, *coded.dictionary.to_pylist()]
        ends = ends + np.arange(len(ends))
        self.at = np.zeros(len(flat) + len(ends), np.int64)
        inside = np.ones(len(self.at), bool)
        inside[ends] = False
        self.at[inside] = np.asarray(coded.indices) + 1
        self.starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends


def hashed(tokens) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) >> 1 for w in tokens), np.int64, len(tokens)).astype(np.uint64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(31)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Sorted values as differences, byte planes apart, which Spark's own compression shrinks."""
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(values) else counts


def quantised(values: np.ndarray, bins: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes and a codebook of at most ``bins`` values: the log means of equally wide bins of the logarithm."""
    if not len(values):
        return np.empty(0, np.uint8), np.empty(0, np.float32)
    logs = np.log(values)
    edges = np.linspace(logs.min(), logs.max(), bins + 1)[1:-1]
    codes = np.searchsorted(edges, logs, "left")
    n = np.bincount(codes, minlength=len(edges) + 1)
    book = np.bincount(codes, logs, len(edges) + 1) / np.maximum(n, 1)
    return codes.astype(np.uint8), np.exp(book).astype(np.float32)


def _ef(arrays: dict, facts: dict, name: str) -> EliasFano:
    return EliasFano(*facts[name], *(arrays[f"{name}.{k}"] for k in EliasFano.PARTS))


def _parts(name: str, ef: EliasFano) -> tuple[dict, dict]:
    return {f"{name}.{k}": a for k, a in ef.arrays().items()}, {name: (ef.n, ef.low)}


class Trie:
    """The model's files, opened as they are asked for."""

    def __init__(self, uri: str, facts: dict) -> None:
        self.uri, self.facts, self.order = uri, facts, facts["order"]
        self.shards, self.rows, self.columns = facts["shards"], facts["rows"], facts["columns"]
        self.words, self.tokens, self.docs = facts["words"], facts["tokens"], facts["docs"]
        self.offsets = np.array(facts["offsets"], np.int64)
        self.open: dict[str, tuple | None] = {}

    def file(self, name: str) -> tuple | None:
        """(arrays, facts, sequences) of a file, None if the model has no such file."""
        if name not in self.open:
            data = mapped(self.uri, name)
            if data is not None:
                arrays, facts = load(data)
                data = (arrays, facts, {k: _ef(arrays, facts, k) for k in ("keys", "pointers") if k in facts})
            self.open[name] = data
        return self.open[name]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids (-1: unknown) and training counts of word hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        where = shard_of(hashes, self.shards)
        for s, own in _groups(where):
            if self.offsets[s] == self.offsets[s + 1]:
                continue
            arrays, facts, efs = self.file(f"w-{s}")
            base, got = np.uint64(facts["base"]), hashes[own]
            at = efs["keys"].find(np.where(got >= base, got - base, 0))
            hit = (at >= 0) & (got >= base)
            ids[own[hit]] = at[hit] + self.offsets[s]
            counts[own[hit]] = arrays["counts"][at[hit]]
        return ids, counts

    def row_of(self, context: np.ndarray) -> np.ndarray:
        return context * self.rows // (self.words + 1)

    def column_of(self, word: np.ndarray) -> np.ndarray:
        return word * self.columns // max(1, self.words)

    def cell_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self.row_of(context) * self.columns + self.column_of(word)

    def corner(self, row, column) -> tuple:
        """First context, contexts, first word and words of cells."""
        a, b = -(-row * (self.words + 1) // self.rows), -(-(row + 1) * (self.words + 1) // self.rows)
        c, d = -(-column * self.words // self.columns), -(-(column + 1) * self.words // self.columns)
        return a, b - a, c, np.maximum(1, d - c)

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Discounted probability of pairs (0 where unseen), the contexts' weights, and the pairs' cells and places (-1)."""
        found, weight, place = np.zeros(len(word)), np.ones(len(word)), np.full(len(word), -1, np.int64)
        cell = self.cell_of(context, word)
        for s, own in _groups(cell):
            row, column = divmod(s, self.columns)
            c0, _, w0, width = self.corner(row, column)
            arrays, _, _ = self.file(f"g-{row}")
            local = context[own] - c0
            weight[own] = arrays["book"][arrays["codes"][local]]
            held = self.file(f"n2-{s}")
            if held is not None:
                _look_up(held, local, local * width + word[own] - w0, own, found, place)
        return found, weight, cell, place

    def longer(self, n: int, cell: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``pairs`` for level n: contexts are places of level n - 1 in a cell; an unknown word is -1."""
        found, weight, place = np.zeros(len(word)), np.ones(len(word)), np.full(len(word), -1, np.int64)
        for s, own in _groups(cell):
            arrays, _, _ = self.file(f"n{n - 1}-{s}")
            weight[own] = arrays["after_book"][arrays["after"][context[own]]]
            held, own = self.file(f"n{n}-{s}"), own[word[own] >= 0]
            if held is not None and len(own):
                _look_up(held, context[own], context[own] * self.words + word[own], own, found, place)
        return found, weight, place


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of every value of small non-negative keys."""
    if len(keys):
        order = np.argsort(keys.astype(np.uint16) if keys.max() < 65536 else keys, kind="stable")
        ends = np.flatnonzero(np.diff(keys[order])) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(order)], strict=True):
            yield int(keys[order[a]]), order[a:b]


def _look_up(held: tuple, context: np.ndarray, key: np.ndarray, own: np.ndarray, found: np.ndarray, place: np.ndarray) -> None:
    """Searches each key within its context's stretch; fills in probabilities and places."""
    arrays, _, efs = held
    first, last = (x.astype(np.int64) for x in efs["pointers"].access_two(context))
    at = efs["keys"].find(key, first, last)
    hit = at >= 0
    found[own[hit]] = arrays["book"][arrays["codes"][at[hit]]]
    place[own[hit]] = at[hit]


class Reader:
    """Turns texts into ids, with a bounded table of the words seen last."""

    def __init__(self, trie: Trie) -> None:
        self.trie, self.slots = trie, {}
        self.ids, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, counts and contexts of all tokens, ends included, and each text's first token."""
        if len(self.slots) > KNOWN:
            self.slots, self.ids, self.counts = {}, np.empty(0, np.int64), np.empty(0, np.int64)
        tokens = Tokens(texts)
        new = [w for w in tokens.words if w not in self.slots]
        if new:
            ids, counts = self.trie.ids(hashed(new))
            self.slots.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        slot = np.fromiter(map(self.slots.__getitem__, tokens.words), np.int64, len(tokens.words))
        ids, counts = self.ids[slot][tokens.at], self.counts[slot][tokens.at]
        contexts = np.concatenate(([0], ids[:-1]))
        contexts[tokens.starts] = self.trie.words  # the begin mark
        return ids, counts, contexts, tokens.starts


_readers: dict[str, Reader] = {}


def _reader(uri: str, facts: dict) -> Reader:
    if uri not in _readers:
        _readers.clear()
        _readers[uri] = Reader(Trie(uri, facts))
    return _readers[uri]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes of text (the first column); a longer text is a slice of its own."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0)).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK, "right")))
            yield batch.slice(a, b - a)
            a = b


PACKED = "shard int, parts array<binary>"


def _batch(shards: list, parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(parts, pa.list_(pa.binary()))], ["shard", "parts"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(shard, its rows' parts) of a partition, which is dealt one shard."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for s, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(s, []).append(parts.as_py())
    while held:
        yield held.popitem()


def _split_words(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((keys, shard))
    keys, counts = keys[order], counts[order]
    shards, parts, a = [], [], 0
    for s, own in _groups(shard):
        b = a + len(own)
        shards.append(s)
        parts.append([packed(keys[a:b]), planes(counts[a:b])])
        a = b
    return _batch(shards, parts)


def _ngrams(trie: Trie, contexts: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """The n-grams of a stretch of tokens by cell, counted.

    A row's parts are, for pairs, their keys in the cell and their counts; for each further level,
    how many n-grams hang below each of the level before, their last words and their counts.
    """
    keys, back, n = np.unique(contexts.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_inverse=True, return_counts=True)
    context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cell = trie.cell_of(context, word)
    c0, _, w0, width = trie.corner(*np.divmod(cell, trie.columns))
    levels = [(cell, (context - c0) * width + word - w0, None, n)]
    inside = np.ones(len(ids), bool)
    before = back
    for _ in range(3, trie.order + 1):
        inside[starts[starts < len(ids)]] = False  # an n-gram begins no earlier than the begin mark
        at = np.flatnonzero(inside)
        above = levels[-1]
        keys, back, n = np.unique(before[at - 1].astype(np.uint64) << np.uint64(32) | ids[at].astype(np.uint64), return_inverse=True, return_counts=True)
        parent, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        levels.append((above[0][parent], word, np.bincount(parent, minlength=len(above[0])), n))
        before = np.zeros(len(ids), np.int64)
        before[at] = back
        starts = starts + 1
    firsts = [np.cumsum(below) - below for _, _, below, _ in levels[1:]]
    shards, rows = [], []
    for s, own in _groups(cell):
        own = own[np.argsort(levels[0][1][own], kind="stable")]
        row = [packed(levels[0][1][own].astype(np.uint64)), planes(levels[0][3][own])]
        for (_, word, below, n), first in zip(levels[1:], firsts, strict=True):
            children = below[own]
            own = np.repeat(first[own], children) + _ramps(children)
            row += [planes(children), planes(word[own]), planes(n[own])]
        shards.append(s)
        rows.append(row)
    return _batch(shards, rows)


def _ramps(lengths: np.ndarray) -> np.ndarray:
    """0..k-1 for each length k, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def train(texts: DataFrame, order: int = ORDER, shard_tokens: int = 1_500_000) -> tuple[str, dict]:
    """Counts the texts of ``texts(text)`` and writes the trie: (its folder, its facts)."""
    spark = texts.sparkSession
    texts = texts.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    uri, shards = shared_dir(spark), max(1, min(MOST_SHARDS, -(-size // SHARD_BYTES)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            keys, n = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return _split_words(shard_of(keys, shards), keys, n)

        for part in _chunks(batches):
            tokens = Tokens(part.column(0))
            held.append((hashed(tokens.words), np.bincount(tokens.at, minlength=len(tokens.words))))
            size += len(tokens.words)
            if size >= FLUSH:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    def build_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in _by_shard(batches):
            keys, n = summed(np.concatenate([unpacked(k) for k, _ in rows]), np.concatenate([from_planes(c) for _, c in rows]))
            ef, base = EliasFano.encode(keys - keys[0]), int(keys[0])
            arrays, facts = _parts("keys", ef)
            put(uri, f"w-{s}", dump(arrays | {"counts": n.astype("<u4" if n.max() < 2**32 else "<u8")}, facts | {"base": base}))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["shard", "n", "total"])

    counted = texts.mapInArrow(count_words, PACKED).repartitionById(shards, F.col("shard"))
    sizes = {r.shard: (r.n, r.total) for r in counted.mapInArrow(build_words, "shard int, n long, total long").collect()}  # a row a shard
    offsets = np.concatenate(([0], np.cumsum([sizes.get(s, (0, 0))[0] for s in range(shards)]))).tolist()
    n_tokens = sum(t for _, t in sizes.values())
    if offsets[-1] >= 2**31:
        raise ValueError("more than 2**31 distinct words")
    cells = max(-(-n_tokens // shard_tokens), min(32, -(-n_tokens // 250_000)), 1)
    columns = 4 if cells >= 8 else 1
    facts = {"order": order, "shards": shards, "offsets": offsets, "words": offsets[-1], "tokens": n_tokens, "docs": 0, "rows": -(-cells // columns), "columns": columns}
    rows = facts["rows"]
    if n_tokens:
        facts["docs"] = int(Trie(uri, facts).ids(hashed([END]))[1][0])

    def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(uri, facts)
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            shift = np.cumsum([0, *(len(h[0]) for h in held)])
            starts = np.concatenate([h[2] + a for h, a in zip(held, shift[:-1], strict=True)])
            return _ngrams(reader.trie, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), starts)

        for part in _chunks(batches):
            ids, _, contexts, starts = reader.read(part.column(0))
            held.append((contexts, ids, starts))
            size += len(ids)
            if size >= FLUSH:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    def build_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _reader(uri, facts).trie
        for s, parts in _by_shard(batches):
            c0, contexts, _, width = (int(x) for x in trie.corner(*divmod(s, trie.columns)))
            mine = [unpacked(p[0]) for p in parts]
            keys, n = summed(np.concatenate(mine), np.concatenate([from_planes(p[1]) for p in parts]))
            places = [np.searchsorted(keys, m) for m in mine]
            context = (keys // np.uint64(width)).astype(np.int64)
            total = _totals(trie, c0, contexts)[context]
            for level in range(2, order + 1):
                discount = DISCOUNTS[min(level, 3) - 2]
                pointers = np.searchsorted(context, np.arange(contexts + 1))
                arrays, held = _parts("keys", EliasFano.encode(keys))
                more, also = _parts("pointers", EliasFano.encode(pointers))
                codes, book = quantised((n - discount) / np.maximum(total, 1))
                arrays |= more | {"codes": codes, "book": book}
                if level < order:
                    below = [from_planes(p[3 * level - 4]) for p in parts]
                    up = np.concatenate([np.repeat(at, b) for at, b in zip(places, below, strict=True)])
                    new = up.astype(np.uint64) * np.uint64(trie.words) + np.concatenate([from_planes(p[3 * level - 3]) for p in parts]).astype(np.uint64)
                    next_keys, next_n = summed(new, np.concatenate([from_planes(p[3 * level - 2]) for p in parts]))
                    next_context = (next_keys // np.uint64(trie.words)).astype(np.int64)
                    different = np.bincount(next_context, minlength=len(keys))
                    after = DISCOUNTS[min(level + 1, 3) - 2] * different / n
                    arrays["after"], arrays["after_book"] = quantised(np.where(different > 0, after, 1.0))
                    ends = np.cumsum([0, *(int(b.sum()) for b in below)])
                    found = np.searchsorted(next_keys, new)
                    places = [found[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                put(uri, f"n{level}-{s}", dump(arrays, held | also))
                if level < order:
                    if not len(next_keys):
                        break
                    contexts, total = len(keys), n[next_context]
                    keys, n, context = next_keys, next_n, next_context
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], ["shard"])

    def build_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _reader(uri, facts).trie
        for batch in batches:
            for row in batch.column(0).to_pylist():
                c0, contexts, _, _ = (int(x) for x in trie.corner(row, 0))
                different = np.zeros(contexts, np.int64)
                for s in range(row * trie.columns, (row + 1) * trie.columns):
                    held = trie.file(f"n2-{s}")
                    if held is not None:
                        different += np.diff(held[2]["pointers"].access(np.arange(contexts + 1)).astype(np.int64))
                weight = np.where(different > 0, DISCOUNTS[0] * different / np.maximum(_totals(trie, c0, contexts), 1), 1.0)
                codes, book = quantised(weight)
                put(uri, f"g-{row}", dump({"codes": codes, "book": book}, {}))
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64())], ["row"])

    if n_tokens:
        counted = texts.mapInArrow(count_ngrams, PACKED).repartitionById(rows * columns, F.col("shard"))
        counted.mapInArrow(build_levels, "shard int").count()
        spark.range(0, rows, 1, min(rows, 1000)).mapInArrow(build_weights, "row long").count()
    return uri, facts


def _totals(trie: Trie, first: int, n: int) -> np.ndarray:
    """How often each of n contexts from ``first`` stands before a token: as often as it stands."""
    out = np.ones(n, np.int64)
    for s in range(trie.shards):
        a, b = max(first, int(trie.offsets[s])), min(first + n, int(trie.offsets[s + 1]))
        if a < b:
            out[a - first : b - first] = trie.file(f"w-{s}")[0]["counts"][a - trie.offsets[s] : b - trie.offsets[s]]
    if first <= trie.words < first + n:
        out[trie.words - first] = max(1, trie.docs)
    return out


def probabilities(trie: Trie, ids: np.ndarray, counts: np.ndarray, contexts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smoothed word probability, interpolated probability) of every token of a chunk of texts."""
    single = (counts + 0.5) / (trie.tokens + 0.5 * (trie.words + 1))
    if not trie.tokens or trie.order < 2:
        return single, single
    p = single.copy()
    both = np.flatnonzero((ids >= 0) & (contexts >= 0))
    pairs, back = np.unique(contexts[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64), return_inverse=True)
    found, weight, cells, places = trie.pairs((pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
    p[both] = found[back] + weight[back] * single[both]
    after = np.flatnonzero((ids < 0) & (contexts >= 0))
    if len(after):  # an unknown word after a known one: only the context's weight
        known, at = np.unique(contexts[after], return_inverse=True)
        p[after] *= trie.pairs(known, np.zeros(len(known), np.int64))[1][at]
    cell, place = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
    cell[both], place[both] = cells[back], places[back]
    first = np.zeros(len(ids), bool)
    for n in range(3, trie.order + 1):
        first[starts[starts < len(ids)]] = True
        own = np.flatnonzero(~first[1:] & (place[:-1] >= 0)) + 1
        next_place = np.full(len(ids), -1, np.int64)
        found, weight, next_place[own] = trie.longer(n, cell[own - 1], place[own - 1], ids[own])
        p[own] = found + weight * p[own]
        moved = cell[own - 1]
        cell[own], place, starts = moved, next_place, starts + 1
    return single, p


def score(docs: DataFrame, model: tuple[str, dict]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs(text, doc_id, held_out)."""
    uri, facts = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(uri, facts)
        for part in _chunks(batches):
            ids, counts, contexts, starts = reader.read(part.column(0))
            single, p = probabilities(reader.trie, ids, counts, contexts, starts)
            total = lambda x: np.add.reduceat(x, starts)
            columns = [
                part.column(1),
                part.column(2),
                pa.array(np.diff(np.append(starts, len(ids)))),
                pa.array(total((counts > 0).astype(np.int64))),
                pa.array(np.full(part.num_rows, facts["tokens"], np.int64)),
                pa.array(total(np.log10(single))),
                pa.array(total(np.log10(p))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("text", "doc_id", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_model_scores(docs: DataFrame, folds: int = 5, held: int = 1, order: int = ORDER) -> DataFrame:
    """Trains on the rows whose crc32(doc_id) modulo ``folds`` is not ``held`` and scores all rows.

    ``order`` is the longest n-gram's length. A null text counts as empty: its only token is the
    end. A null doc_id is hashed as an empty text and stays null. Repeated rows count and are scored
    each; without training rows every word is unknown; an empty table gives none. Other columns are
    not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", remainder("doc_id", folds) == held)
    return score(rows, train(rows.where(~F.col("held_out")), order))
