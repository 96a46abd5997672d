"""Token counts by a two-tier lookup on the map side: pre-tokens are never exchanged.

First tier: a compact hash table of the corpus's frequent pre-tokens, which maps
128-bit names to lengths in tokens and is broadcast.  Second tier: a cache in each
worker, which encodes what the table lacks.  To find the frequent ones each task
counts the pre-tokens of its rows and hands on names, lengths and counts; sums by
name are taken by Spark, with partial sums before the exchange.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm._kernels import slices
from chronotext.llm.bpe import WordCache, merge, send, splitter, vocabulary

FREQUENT = 50_000
SUMMARY = 20_000


def name_of(word: str) -> bytes:
    """128-bit name of a pre-token."""
    import xxhash

    return xxhash.xxh3_128_digest(word.encode(errors="replace"))


def frequent_pretokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", most: int = FREQUENT, summary: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """(names, lengths) of the most frequent pre-tokens of all texts; names are rows of 16 bytes.

    Each task counts all pre-tokens of its rows, in bounded memory, and hands on
    its `summary` most frequent ones.  The table only decides what is looked up
    where: counts are right with any table.  Equal counts are taken by name.
    """
    sent = send(docs.sparkSession, ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        known = sent.value
        c: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                c.update(split(text))
                if len(c) > 40 * summary:
                    c = Counter(dict(c.most_common(20 * summary)))
        top = c.most_common(summary)
        names = np.frombuffer(b"".join(name_of(w) for w, _ in top), np.int64).reshape(-1, 2)
        size = [len(merge(w.encode(errors="replace"), known)) for w, _ in top]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), pa.array(size, pa.int32()), pa.array([n for _, n in top], pa.int64())],
            names=["a", "b", "size", "n"],
        )

    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    sums = texts.mapInArrow(count, "a long, b long, size int, n long").groupBy("a", "b").agg(F.first("size").alias("size"), F.sum("n").alias("n"))
    got = sums.orderBy(F.desc("n"), "a", "b").limit(most).select("a", "b", "size").toArrow()
    names = np.stack([got.column(c).to_numpy().astype(np.int64) for c in ("a", "b")], axis=1)
    return names, got.column("size").to_numpy().astype(np.int32)


class Lengths(dict):
    """Lengths of pre-tokens that a worker has met: from the table of frequent ones, else by encoding."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, ranks: dict[bytes, int]):
        super().__init__()
        raw = np.ascontiguousarray(names).tobytes()
        self.table = dict(zip((raw[k : k + 16] for k in range(0, len(raw), 16)), sizes.tolist()))
        self.rare = WordCache(lambda w: len(merge(w.encode(errors="replace"), ranks)))

    def __missing__(self, word: str) -> int:
        n = self.rare.get(word)
        if n is None:
            n = self.table.get(name_of(word))
            if n is None:
                return self.rare[word]
            if len(word) < 100:  # no more entries than the table has
                self[word] = n
        return n


_lengths: dict[int, Lengths] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, frequent: int = FREQUENT, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row: how many ids the byte-level BPE gives its text.

    The table of frequent pre-tokens has a fixed size (20 bytes for each of
    `frequent` names); a miss is encoded once and kept in the worker's bounded
    cache.  Counts are exact, unless two pre-tokens have one 128-bit name.

    A null text has a null count, an empty one 0.  Null ids and repeated rows are
    kept as they are.  Very long texts and words are counted whole.  An empty
    table gives no rows.  Other columns are ignored.  Ids are cast to long.
    pattern: how texts are split, if the vocabulary isn't one of the usual pattern's.
    """
    ranks, pattern = vocabulary(vocabulary_path, pattern)
    names, sizes = frequent_pretokens(docs, ranks, pattern, text_col, frequent)
    sent = send(docs.sparkSession, (names, sizes, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.id not in _lengths:
            _lengths.clear()
            _lengths[sent.id] = Lengths(*sent.value)
        look = _lengths[sent.id].__getitem__
        split = splitter(pattern)
        for batch in batches:
            for piece in slices(batch, "text"):
                n = [None if t is None else sum(map(look, split(t))) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long")
