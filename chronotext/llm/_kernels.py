"""NumPy kernels over Arrow string buffers: no Python object per word.

Texts are taken as the UTF-8 bytes of an Arrow array.  A word is a maximal run
of ASCII letters, ASCII digits and non-ASCII bytes of the lower-cased text.
Word hashes are polynomial hashes modulo 2**64, mixed; they name equal words
equally on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

IS_WORD = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    IS_WORD[_c] = True
IS_WORD[128:] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, U64(base), dtype=U64)
        have[0] = U64(1)
        np.multiply.accumulate(have, out=have)
        if size > 1 << 24:  # only for one huge text; not worth keeping
            return have[:n]
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch with about max_bytes of text each; a longer text is alone in its piece."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    lo = 0
    while lo < n:
        done = end[lo - 1] if lo else 0
        hi = int(np.searchsorted(end, done + max_bytes, side="right"))
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        lo = hi


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len+1 offsets into them; nulls count as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = texts.buffers()
    if off is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of the texts of one Arrow array.

    data, offsets: lower-cased bytes of all texts; start, end: byte bounds of
    each word in data; first: index of the first word of each text, len+1 long.
    """

    def __init__(self, texts: pa.Array, lowered: bool = False):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        self.data, self.offsets = buffers(texts if lowered else pc.utf8_lower(texts))
        word = IS_WORD[self.data]
        prev = np.empty_like(word)
        if len(word):
            prev[0] = False
            prev[1:] = word[:-1]
            cut = self.offsets[:-1]
            prev[cut[cut < len(word)]] = False
        self.start = np.flatnonzero(word & ~prev)
        nxt = np.zeros_like(word)
        if len(word):
            nxt[:-1] = word[1:] & prev[1:]  # prev is cleared where a text begins
        self.end = np.flatnonzero(word & ~nxt) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def prefix_sums(self) -> np.ndarray:
        p = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * powers(_BASE, len(self.data)), out=p[1:])
        return p

    def span_hash(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair, independent of the place."""
        return mix((sums[end] - sums[start]) * powers(_BASE_INV, len(self.data) + 1)[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.prefix_sums(), self.start, self.end)

    def strings(self) -> pa.Array:
        """The words themselves."""
        bounds = np.r_[0, np.cumsum(self.end - self.start)]
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(bounds), pa.py_buffer(self.data[IS_WORD[self.data]])])

    def text_of_word(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for every i with i+k <= len(h), by joining the names of two shorter grams."""
    if k <= 1:
        return h
    if len(h) < k:
        return h[:0]
    a = k // 2
    left, right = word_grams(h, a), word_grams(h, k - a)
    n = len(h) - k + 1
    return mix(left[:n] * U64(0xD6E8FEB86659FD93) + right[a : a + n] + U64(k))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over words: a gram of k words begins here and stays in its text."""
    n = int(first[-1]) if len(first) else 0
    ok = np.ones(n, dtype=bool)
    if k > 1 and n:
        size = np.diff(first)
        back = np.minimum(size, k - 1)
        at = np.repeat(first[1:] - back, back) + ragged_arange(back)
        ok[at] = False
    return ok


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def char_positions(text: bytes, at: np.ndarray) -> np.ndarray:
    """Code-point index of each byte offset of one UTF-8 text."""
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    sums = np.zeros(len(text) + 1, dtype=np.int64)
    np.cumsum(lead, out=sums[1:])
    return sums[at]
