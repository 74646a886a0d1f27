"""Elias-Fano coded monotone sequences, read in place from a memory map.

``low`` bits of each value are packed; the high parts are unary in a bit vector with a small
directory. All reads take arrays of places or values at once.
"""

from __future__ import annotations

import numpy as np


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Little-endian bit packing, padded so that eight bytes can be read at any value."""
    out = np.zeros(((len(values) * width + 7) // 8 + 15) // 8 * 8, np.uint8)
    if width:
        step = 8 * 32768
        for k in range(0, len(values), step):
            part = values[k : k + step]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
            packed = np.packbits(bits.ravel(), bitorder="little")
            out[k * width // 8 : k * width // 8 + len(packed)] = packed
    return out


STEP = 32  # every so many zeros and ones the directory names their word
LOW = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)


def _in_byte() -> np.ndarray:
    """table[byte * 8 + r]: the place of the byte's one number r, 0 where it has fewer."""
    table = np.zeros(256 * 8, np.int64)
    for byte in range(256):
        for r, place in enumerate(i for i in range(8) if byte >> i & 1):
            table[byte * 8 + r] = place
    return table


IN_BYTE = _in_byte()


def _select(bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of one number ``rank`` (from 0) in each 64-bit word, which holds it."""
    two = np.uint64(2)
    sums = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
    sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> two) & np.uint64(0x3333333333333333))
    sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * LOW  # ones up to each byte's end
    rank = rank.astype(np.uint64)
    byte = np.bitwise_count(((rank * LOW | HIGH) - sums) & HIGH).astype(np.uint64) << np.uint64(3)
    before = ((sums << np.uint64(8)) >> byte) & np.uint64(0xFF)
    at = ((bits >> byte) & np.uint64(0xFF)) << np.uint64(3)
    return byte.astype(np.int64) + IN_BYTE[(at + rank - before).astype(np.int64)]


class EliasFano:
    """A sequence of n unsigned integers that never falls, each under 2**63.

    The directory holds the zeros before each 64-bit word, and the word of every 32nd zero and
    one, so a select starts at most a few words before its word.
    """

    PARTS = ("lows", "words", "zeros", "zero_at", "one_at")

    def __init__(self, n: int, low: int, lows: np.ndarray, words: np.ndarray, zeros: np.ndarray, zero_at: np.ndarray, one_at: np.ndarray) -> None:
        self.n, self.low, self.lows, self.words, self.zeros, self.zero_at, self.one_at = n, low, lows, words, zeros, zero_at, one_at

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        lows = _pack(values & np.uint64((1 << low) - 1), low)
        high = (values >> np.uint64(low)).astype(np.int64)
        size = (int(high[-1]) if n else 0) + n + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        zeros = np.arange(len(ones)) * 64 - ones
        kind = "<u4" if zeros[-1] < 2**32 else "<u8"
        zero_at = np.searchsorted(zeros, np.arange(0, zeros[-1], STEP), "right") - 1
        one_at = np.searchsorted(ones, np.arange(0, max(n, 1), STEP), "right") - 1
        return cls(n, low, lows, words, zeros.astype(kind), np.minimum(zero_at, len(words) - 1).astype(kind), np.minimum(one_at, len(words) - 1).astype(kind))

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.PARTS}

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low
        span = np.lib.stride_tricks.as_strided(self.lows.view("<u8"), (len(self.lows) - 7,), (1,))
        return (span[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def _word(self, hint: np.ndarray, k: np.ndarray, ones: bool) -> tuple[np.ndarray, np.ndarray]:
        """The word that holds zero or one number k, and how many of them stand before it."""
        last = len(self.words) - 1
        word = hint[np.minimum(k // STEP, len(hint) - 1)].astype(np.int64)
        held = lambda w: w * 64 - self.zeros[w] if ones else self.zeros[w].astype(np.int64)
        late = np.flatnonzero((word < last) & (held(np.minimum(word + 1, last)) <= k))
        for _ in range(8):
            if not len(late):
                break
            word[late] += 1
            w = word[late]
            late = late[(w < last) & (held(np.minimum(w + 1, last)) <= k[late])]
        if len(late):  # a long run of the other bit: search the whole directory
            whole = np.arange(len(self.zeros)) * 64 - self.zeros if ones else self.zeros
            word[late] = np.minimum(np.searchsorted(whole, k[late].astype(whole.dtype), "right").astype(np.int64) - 1, last)
        return word, held(word)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of zero number k (from 0) in the bit vector; past the last zero, its end."""
        word, before = self._word(self.zero_at, k, False)
        return word * 64 + _select(~self.words[word], k - before)

    def _one(self, k: np.ndarray) -> np.ndarray:
        word, before = self._word(self.one_at, k, True)
        return word * 64 + _select(self.words[word], k - before)

    def _next(self, place: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of one or zero number k, which is the next after ``place``: mostly in the same word."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        bits = self.words[word] if ones else ~self.words[word]
        rest = (bits >> bit) >> np.uint64(1)
        out = place + 1 + np.bitwise_count((rest & -rest) - np.uint64(1)).astype(np.int64)
        late = np.flatnonzero(rest == 0)
        if len(late):
            out[late] = self._one(k[late]) if ones else self._zero(k[late])
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at places."""
        at = np.asarray(at, np.int64)
        return ((self._one(at) - at).astype(np.uint64) << np.uint64(self.low)) | self._low(at)

    def access_two(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places and at the places after them."""
        one = self._one(at)
        following, low = self._next(one, at + 1, True), np.uint64(self.low)
        return ((one - at).astype(np.uint64) << low) | self._low(at), ((following - at - 1).astype(np.uint64) << low) | self._low(at + 1)

    def _bucket(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places [a, b) of the elements that share each value's high part."""
        top = len(self.words) * 64 - self.n - 1
        high = np.minimum((values >> np.uint64(self.low)).astype(np.int64), top)
        before = self._zero(np.maximum(high - 1, 0))
        end = np.where(high > 0, self._next(before, high, False), before)
        return np.minimum(np.where(high > 0, before - high + 1, 0), self.n), np.minimum(end - high, self.n)

    def successor(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The first place in [first, last) whose value is not smaller; ``last`` (or n) if there is none."""
        return self._search(values, first, last)[0]

    def _search(self, values: np.ndarray, first: np.ndarray | None, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The successors' places, and the ends of the stretches in which values share the high part."""
        values = np.asarray(values, np.uint64)
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        a, b = self._bucket(values)
        if first is not None:
            a, b = np.maximum(a, first), np.minimum(np.maximum(b, first), last)
            a = np.minimum(a, last)
        end = b.copy()
        want = values & np.uint64((1 << self.low) - 1)
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < want[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
            open_ = open_[a[open_] < b[open_]]
        return a, end

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of each value in [first, last), else -1."""
        values = np.asarray(values, np.uint64)
        at, end = self._search(values, first, last)
        out = np.full(len(at), -1, np.int64)
        top = np.uint64(len(self.words) * 64 - self.n - 1)
        inside = np.flatnonzero((at < end) & ((values >> np.uint64(self.low)) <= top))
        hit = inside[self._low(at[inside]) == (values[inside] & np.uint64((1 << self.low) - 1))]
        out[hit] = at[hit]
        return out


def dump(arrays: dict[str, np.ndarray], facts: dict) -> bytes:
    """One file: a JSON line, then the arrays, each at a multiple of eight bytes."""
    import json

    head, parts, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = (a.dtype.str, at, len(a))
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    line = json.dumps({"facts": facts, "arrays": head}).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return line + b"".join(parts)


def load(buffer) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays as views of a buffer or memory map, and the facts."""
    import json

    end = buffer.find(b"\n")
    head = json.loads(buffer[:end])
    arrays = {k: np.frombuffer(buffer, t, n, end + 1 + at) for k, (t, at, n) in head["arrays"].items()}
    return arrays, head["facts"]
