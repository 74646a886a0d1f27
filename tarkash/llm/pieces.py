"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A score-ordered agenda holds adjacent symbol pairs whose joined form is a piece; the best
score, then the leftmost pair, is merged first. The text is cut into segments no piece can
span, and the ids of short segments are kept in a bounded cache, so most words are merged
once per worker. Documents chosen by a hash are compared with the sentencepiece library in
every Arrow batch; a difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE = 1_500_000
CACHED_CHARS = 48


class _Cache(dict):
    """The ids of segments; long segments are worked out each time."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, segment: str) -> bytes:
        ids = self.encode(segment)
        if len(segment) <= CACHED_CHARS:
            self[segment] = ids
        return ids


class MergeCodec:
    """Encoder and decoder of one merge-type model, built from the model file's bytes.

    Supports identity normalisation with byte fallback and no user-defined symbols; other
    models raise NotImplementedError.
    """

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(proto)
        kinds = pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise NotImplementedError("a merge-type model with byte fallback is needed")
        if model.normalizer_spec.precompiled_charsmap or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise NotImplementedError("character maps and user-defined symbols are not supported")
        spec = model.normalizer_spec
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if not self.escape or model.trainer_spec.treat_whitespace_as_suffix:
            raise NotImplementedError("white space must be escaped and stand before words")
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.unused: set[str] = set()
        self.byte_ids = [0] * 256
        self.surface: list[str] = []
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            self.surface.append("")
            if p.type in (kinds.NORMAL, kinds.UNUSED):
                self.ids[p.piece], scores[p.piece] = i, p.score
                self.surface[i] = p.piece.replace(SPACE, " ")
                if p.type == kinds.UNUSED:
                    self.unused.add(p.piece)
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif p.type == kinds.UNKNOWN:
                self.surface[i] = model.trainer_spec.unk_surface
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        if any(len(p) > 1000 for p in self.ids):
            raise NotImplementedError("a piece is too long")
        order = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: order[x] for p, x in scores.items()}
        self.segments = self._boundaries()
        self.cache = _Cache(self._segment)

    def _boundaries(self) -> re.Pattern:
        """A pattern of segments no piece can span.

        Whether a place is a boundary depends on its two neighbours only, so a pattern that cuts
        no piece is safe. Letters part from other characters; those that a piece joins to the
        other class count with it.
        """
        odd = ""
        for _ in range(3):
            letter, other = rf"[^\W\d_{odd}]", rf"[^{SPACE}\w]|[\d_{odd}]"
            fine = re.compile(rf"{SPACE}*(?:{letter}+|(?:{other})+)|{SPACE}+")
            cut = [p for p in self.ids if len(fine.findall(p)) != 1]
            if not cut:
                return fine
            odd += "".join({re.escape(c) for p in cut for c in p if not c.isalpha() and re.fullmatch(r"[^\W\d_]", c)})
        words = re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        return words if all(len(words.findall(p)) == 1 for p in self.ids) else re.compile(r"(?s).+")

    def _pieces(self, text: str) -> list[str]:
        """Merges by agenda; an entry is one integer: rank of the score, left place, joined length."""
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, push, pop, unused = self.ranks.get, heapq.heappush, heapq.heappop, self.unused
        agenda = [r << 42 | i << 10 | 2 for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        parts: dict[str, tuple[str, str]] = {}
        while agenda:
            entry = pop(agenda)
            left = entry >> 10 & 0xFFFFFFFF
            whole, right = symbols[left], after[left]
            if not whole or right < 0 or len(whole) + len(symbols[right]) != entry & 1023:
                continue
            joined = whole + symbols[right]
            if joined in unused:
                parts[joined] = (whole, symbols[right])
            symbols[left] = whole = joined
            symbols[right] = ""
            after[left] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = left
                joined = whole + symbols[beyond]
                if (r := rank(joined)) is not None:
                    push(agenda, r << 42 | left << 10 | len(joined))
            previous = before[left]
            if previous >= 0:
                joined = symbols[previous] + whole
                if (r := rank(joined)) is not None:
                    push(agenda, r << 42 | previous << 10 | len(joined))
        out: list[str] = []
        for s in symbols:
            todo = [s] if s else []
            while todo:
                piece = todo.pop()
                if piece in self.unused and piece in parts:
                    todo += reversed(parts[piece])
                else:
                    out.append(piece)
        return out

    def _segment(self, segment: str) -> bytes:
        out = array("I")
        for piece in self._pieces(segment):
            i = self.ids.get(piece)
            if i is None:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(i)
        return out.tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids, without begin and end, as little-endian unsigned 32-bit integers."""
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        if not text:
            return b""
        if self.prefix:
            text = " " + text
        text = text.replace(" ", SPACE)
        if len(self.cache) > CACHE:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.segments.findall(text)))

    def encode(self, text: str, begin: bool = False, end: bool = False) -> list[int]:
        ids = array("I", self.encode_bytes(text)).tolist()
        return [self.bos] * begin + ids + [self.eos] * end

    def decode(self, ids) -> str:
        """The text of ids: control ids vanish, runs of byte ids become UTF-8, one leading space goes."""
        surface = self.surface
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            out, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(surface[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode_documents(
    docs: DataFrame, proto: bytes, begin: bool = True, end: bool = True, check_every: int = 16, keep: bool = True
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and with ``keep`` token_ids, decoded) of every row.

    A null text counts as empty; an empty text has only the begin and end ids. Repeated rows give
    repeated results, an empty table none; other columns are not read. ``check_every`` k compares
    documents whose id has crc32 divisible by k with the library (0: none).
    """
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec = state.setdefault("codec", None) or MergeCodec(proto)
        state["codec"] = codec
        library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        first = array("I", [codec.bos] * begin).tobytes()
        last = array("I", [codec.eos] * end).tobytes()
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), {k: [] for k in ("n", "i", "d", "ids", "text")}
            for key, value in zip(keys, batch.column(1), strict=True):
                text = value.as_py() or ""
                data = first + codec.encode_bytes(text) + last
                ids = array("I", data)
                back = codec.decode(ids)
                if check_every and zlib.crc32(str(key).encode()) % check_every == 0:
                    wanted = library.encode(text, add_bos=begin, add_eos=end, num_threads=1)
                    if wanted != ids.tolist() or library.decode(wanted) != back:
                        raise ValueError(f"document {key}: ids or text differ from the library's")
                rows["n"].append(len(ids))
                rows["i"].append(hashlib.sha256(data).hexdigest())
                rows["d"].append(hashlib.sha256(back.encode()).hexdigest())
                if keep:
                    rows["ids"].append(ids.tolist())
                    rows["text"].append(back)
            columns = [pa.array(keys, pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["i"], pa.string()), pa.array(rows["d"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array(rows["ids"], pa.list_(pa.int64())), pa.array(rows["text"], pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<long>, decoded string" * keep
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
