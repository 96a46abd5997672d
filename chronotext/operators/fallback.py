"""Segments of texts without any alignment, text by text: no exchange, and no row per token."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.functions.frames import half_up
from chronotext.functions.text import _normalized, _places, picked, slices

Spans = list[tuple[int, int]]

WORDS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("start", "end", "score"))]))


def record(words: bool) -> T.StructType:
    """A segment's fields: its words, or only their number."""
    times = [T.StructField(n, T.DoubleType()) for n in ("start", "end", "duration")]
    last = T.StructField("words", WORDS) if words else T.StructField("n_words", T.IntegerType())
    return T.StructType([T.StructField("seg_pos", T.IntegerType()), *times, T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()), last])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    size = hi - lo
    return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum())) if len(lo) else lo


def _listed(of: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int32)), values)


def segments_of_texts(texts: pa.Array, a: pa.Array, b: pa.Array, given: list[Spans | None], splitter: Callable[[str], Spans] | None, strict: bool, digits: int, words: bool) -> pa.Array:
    """The segments of each text, a list: what merge_multitoken, segment_words and encode_segments give for its interpolated tokens.

    A token reaches to the next one, so tokens and segments are pieces of the
    text's own bytes; spans are found in tokens by binary search over all texts at
    once, whose places follow each other.
    """
    n = len(texts)
    data, off, points, owner, lo, hi = _places(texts)
    _, at = _normalized(texts, owner, picked(data, lo, hi))
    # pieces of one run are one word
    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
    run = at[head]
    own, lo, hi = owner[run], lo[run], hi[run]
    m = len(run)
    pieces = np.bincount(owner[at], minlength=n)
    first = np.r_[0, np.cumsum(pieces)][:-1][own]  # of the text, among pieces
    behind = np.r_[own[1:] == own[:-1], False] if m else own.astype(bool)
    ext = np.where(behind, np.r_[lo[1:], 0][:m], off[own + 1])
    begin, end = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (pc.fill_null(a, 0.0), pc.fill_null(b, 0.0)))
    known = np.asarray(pc.and_(pc.is_valid(a), pc.is_valid(b)))
    with np.errstate(divide="ignore", invalid="ignore"):
        step = ((end - begin) / pieces)[own]
    t0 = begin[own] + (head - first) * step
    t1 = begin[own] + (np.r_[head[1:], len(at)][:m] - first) * step
    # spans of all texts, in code points of all texts
    origin = points[off[:-1]]
    gs, ge = points[lo], points[ext]
    opens = np.searchsorted(own, np.arange(n), side="left")
    closes = np.searchsorted(own, np.arange(n), side="right")
    spans = []
    for i, text in enumerate(texts.to_pylist()):
        if given[i]:
            spans += [(i, k, x, y) for k, (x, y) in enumerate(given[i])]
        elif splitter is not None:
            spans += [(i, k, x, y) for k, (x, y) in enumerate(splitter(text))] if text else []
        elif opens[i] < closes[i]:
            spans.append((i, 0, int(gs[opens[i]] - origin[i]), int(points[hi[closes[i] - 1]] - origin[i])))
    text_of, pos, x, y = np.array(spans, dtype=np.int64).reshape(-1, 4).T
    x, y = x + origin[text_of], y + origin[text_of]
    s = np.searchsorted(gs, x, side="right") - 1
    e = np.searchsorted(gs, y - 1, side="right") - 1
    found = known[text_of]
    for k, limit, inside in ((s, x, np.less), (e, y, np.less_equal)):
        kk = np.maximum(k, 0)
        found = found & (k >= 0) & (m > 0) & (own[kk] == text_of if m else False) & (inside(limit, ge[kk]) if m else False)
    low, high = np.minimum(s, e), np.maximum(s, e)
    if strict:  # the prefix of each text's spans up to the first that isn't found or goes back
        previous = np.r_[-1, high[:-1]] if len(high) else high
        fresh = np.r_[True, text_of[1:] != text_of[:-1]] if len(high) else found
        bad = np.cumsum(~(found & (fresh | (low > previous))))
        start = np.flatnonzero(fresh)
        base = np.repeat(np.r_[0, bad][start], np.diff(np.r_[start, len(bad)]))
        keep = bad - base == 0
    else:
        keep = found
    text_of, pos, s, e, high = text_of[keep], pos[keep], s[keep], e[keep], high[keep]
    by_end = np.lexsort((pos, high))
    text_of, pos, s, e, high = text_of[by_end], pos[by_end], s[by_end], e[by_end], high[by_end]
    # a token belongs to the first segment that ends at or after it
    w0 = np.maximum(np.r_[0, high[:-1] + 1] if len(high) else high, opens[text_of])
    some = np.flatnonzero(w0 <= high)
    some = some[np.lexsort((pos[some], text_of[some]))]
    text_of, pos, s, e, w0, w1 = text_of[some], pos[some], s[some], e[some], w0[some], high[some] + 1
    r = lambda v: pa.array(half_up(v, digits))
    inner = np.maximum(s, w0)
    spoken = picked(data, lo[inner], np.where(inner <= e, ext[e], lo[inner])) if len(s) else pa.array([], pa.large_string())
    zero = pa.array(np.zeros(len(s)))
    if words:
        idx = _ranges(w0, w1)
        w = pa.StructArray.from_arrays([picked(data, lo[idx], ext[idx]).cast(pa.string()), r(t0[idx]), r(t1[idx]), pa.array(np.zeros(len(idx)))], names=["text", "start", "end", "score"])
        last = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(w1 - w0)].astype(np.int32)), w)
    else:
        last = pa.array((w1 - w0).astype(np.int32))
    rows = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), r(t0[s]), r(t1[e]), r(t1[e] - t0[s]), spoken.cast(pa.string()), zero, last], names=record(words).names)
    return _listed(text_of, n, rows)


def fallback_lists(texts: DataFrame, keys: Sequence[str], start: str, end: str, text_col: str, splitter: Callable[[str], Spans] | None, spans_col: str | None, strict: bool, digits: int, words: bool) -> DataFrame:
    """keys and segments, the list of each text's segments (record()); one map over texts, which are taken a megabyte at a time."""
    keys = list(keys)
    slim = texts.select(*keys, F.col(text_col).alias("__text"), F.col(start).cast("double").alias("__a"), F.col(end).cast("double").alias("__b"), *([F.col(spans_col).alias("__spans")] if spans_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                given: list[Spans | None] = [None] * part.num_rows
                if spans_col:
                    given = [[(int(s["start_char"]), int(s["end_char"])) for s in row] if row else None for row in part.column("__spans").to_pylist()]
                found = segments_of_texts(part.column("__text"), part.column("__a"), part.column("__b"), given, splitter, strict, digits, words)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), found], names=[*keys, "segments"])

    return slim.mapInArrow(run, T.StructType([slim.schema[k] for k in keys] + [T.StructField("segments", T.ArrayType(record(words)))]))
