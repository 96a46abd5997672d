"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer."""

from __future__ import annotations

import base64
import heapq
import importlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm._kernels import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 400_000
SHORT = 160
NEVER = 1 << 60
# the published pre-token pattern of the byte-level vocabularies, in the terms of the standard library:
# \p{L} is [^\W\d_] but for marks and number signs, which _number() takes out again
_SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ƺ]+| ?[0-9]+| ?[!-&(-/:-@[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7–-‧]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r -&(-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbbÀ-ƺ–-‧\xbf]*")


def default_vocabulary() -> str:
    return importlib.import_module("public_tokenizers").path(VOCABULARY)


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text.

    With the usual pattern, texts of plain signs (no apostrophe, only Latin letters below U+01BB, ASCII
    digits, common punctuation) go to the standard library's matcher, which has
    the same pre-tokens for them and takes half the time; others to the full pattern.
    """
    import public_tokenizers
    import regex

    whole = regex.compile(pattern)
    full = whole.findall if not whole.groups else lambda text: [m.group() for m in whole.finditer(text)]
    if pattern != public_tokenizers.PATTERN:
        return full
    plain, simple = _PLAIN.fullmatch, _SIMPLE.findall
    return lambda text: simple(text) if plain(text) else full(text)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    A contiguous array of part boundaries and of the ranks of adjacent parts:
    the least rank is found by scanning, its boundary deleted, both neighbouring
    ranks refreshed.  Of equal ranks the leftmost goes first.  The scan is
    quadratic, so pieces beyond SHORT bytes keep the same order in a heap.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n > SHORT:
        return _merge_long(piece, ranks)
    get = ranks.get
    cut = list(range(n + 1))
    rank = [get(piece[i : i + 2], NEVER) for i in range(n - 1)]
    while rank:
        least = min(rank)
        if least == NEVER:
            break
        i = rank.index(least)
        del cut[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(piece[cut[i] : cut[i + 2]], NEVER)
        if i:
            rank[i - 1] = get(piece[cut[i - 1] : cut[i + 1]], NEVER)
    return [ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    nxt, prev = list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or nxt[j] != end:
            continue
        alive[j] = False
        nxt[i] = end
        if end < n:
            prev[end] = i
            if (r := ranks.get(piece[i : nxt[end]])) is not None:
                heapq.heappush(heap, (r, i, nxt[end]))
        if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : end])) is not None:
            heapq.heappush(heap, (r, prev[i], end))
    return [ranks[piece[i : nxt[i]]] for i in range(n) if alive[i]]


class WordCache(dict):
    """pre-token -> result of make(pre-token), in two generations of at most `most` entries each.

    A full generation becomes the old one and what is used again moves back, so
    memory is bounded and words in use stay.
    """

    def __init__(self, make: Callable, most: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= SHORT:
            self[key] = value
        return value


class Encoder:
    """Encodes texts to packed int32 ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = splitter(pattern)
        pack = lambda ids: np.array(ids, dtype="<i4").tobytes()
        self.cache = WordCache(lambda w: pack(merge(w.encode(errors="replace"), ranks)))
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.token = tokens.__getitem__

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token, ids))


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(path or default_vocabulary()), pattern or public_tokenizers.PATTERN


_encoders: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    """One encoder and its cache for each Python worker, kept between tasks."""
    if sent.id not in _encoders:
        _encoders.clear()
        _encoders[sent.id] = Encoder(*sent.value)
    return _encoders[sent.id]


class _Sent:
    """A broadcast and its number."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def send(spark: SparkSession, value) -> _Sent:
    return _Sent(spark.sparkContext.broadcast(value))


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for every row.

    ids are those of the vocabulary; round_trip says that decoding them gives
    the text's UTF-8 bytes again.  One map over whole texts, no shuffle; the
    vocabulary is broadcast (about 1 MB, fixed).

    A null text has null n_tokens, ids and round_trip; an empty text has no ids and
    round_trip true.  Null ids and repeated rows are kept as they are.  Very
    long texts and words are encoded whole.  An empty table gives no rows.  Other
    columns are ignored.  Ids are cast to long.  pattern: how texts are split, if
    the vocabulary isn't one of the usual pattern's.
    """
    sent = send(docs.sparkSession, vocabulary(vocabulary_path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(sent)
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = piece.column("text").to_pylist()
                packed = [b"" if t is None else coder.encode(t) for t in texts]
                size = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                ids = np.frombuffer(b"".join(packed), dtype="<i4")
                gone = np.array([t is None for t in texts])
                ends = np.cumsum(size)
                every = ids.tolist()
                same = [coder.decode(every[e - n : e]) == (t or "").encode(errors="replace") for t, e, n in zip(texts, ends.tolist(), size.tolist())]
                offsets = pa.array(np.r_[0, ends], pa.int32(), mask=np.r_[gone, False])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(size, mask=gone), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(same, mask=gone)],
                    names=["doc_id", "n_tokens", "ids", "round_trip"],
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, text) for every row of (doc_id, ids).

    Null ids give a null text, no ids an empty one; bytes that aren't UTF-8 are
    replaced, an unknown id is an error.  Null and repeated doc_ids are kept.  Any
    number of ids is decoded.  An empty table gives no rows; other columns are
    ignored.  doc_ids are cast to long.
    """
    sent = send(tokens.sparkSession, vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(sent)
        for batch in batches:
            texts = [None if i is None else coder.decode(i).decode(errors="replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    slim = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim.mapInArrow(run, "doc_id long, text string")
