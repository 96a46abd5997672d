"""Approximate location of passages in streams of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_words(files: DataFrame, file_key: str = "audio_path", speeches_col: str = "speeches") -> DataFrame:
    """Words of nested files in order: file_key, word_pos, text, start, end, score."""
    x = files.select(file_key, F.posexplode(speeches_col).alias("__i", "__s")).select(file_key, "__i", F.posexplode("__s.alignments").alias("__j", "__g"))
    x = x.select(file_key, "__i", "__j", F.posexplode("__g.words").alias("__k", "__w"))
    w = Window.partitionBy(file_key).orderBy("__i", "__j", "__k")
    return x.select(file_key, (F.row_number().over(w) - 1).cast("int").alias("word_pos"), "__w.text", "__w.start", "__w.end", "__w.score")


def word_offsets(words: DataFrame, keys: Sequence[str], pos: str = "word_pos", text: str = "text") -> DataFrame:
    """Adds start_char and end_char of each word in the text that all words of a key make up, without separators."""
    w = Window.partitionBy(*keys).orderBy(pos)
    end = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return words.withColumn("end_char", end).withColumn("start_char", F.col("end_char") - F.length(text))


def haystacks(words: DataFrame, keys: Sequence[str], pos: str = "word_pos", text: str = "text") -> DataFrame:
    """One row per key: haystack (all words joined) and ends (the end offset of each word)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"), F.col("end_char").alias("e"))))
    return word_offsets(words, keys, pos, text).groupBy(*keys).agg(listed.alias("__w")).select(*keys, F.array_join(F.transform("__w", lambda x: x.t), "").alias("haystack"), F.transform("__w", lambda x: x.e.cast("int")).alias("ends"))


def word_of_char(ends: np.ndarray, at: int) -> int:
    """Index of the word that holds a character, kept within the words."""
    return int(min(np.searchsorted(ends, max(at, 0), side="right"), len(ends) - 1))


def indel_similarity(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b))."""
    return 200.0 * _lcs(_masks(a), b) / (len(a) + len(b)) if a or b else 100.0


def _masks(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | (1 << i)
    return out | {"": len(s)}


def _lcs(masks: dict[str, int], b: str) -> int:
    """Longest common subsequence by whole-word bit arithmetic: one step of big integers per sign of b."""
    n = masks[""]
    full = (1 << n) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def partial_ratio(needle: str, haystack: str, at_least: float = 0.0) -> tuple[float, int, int] | None:
    """(score, start, end) of the window of the haystack most like the needle, leftmost of equal ones; None below at_least.

    Windows have the needle's length, or are shorter where they begin or end with
    the haystack; a needle longer than the haystack changes places with it.  A
    window is scored only if its signs, whatever their order, could still beat
    the best so far: that bound is counted for all windows at once.
    """
    if not needle or not haystack:
        return None
    if len(needle) > len(haystack):
        score = partial_ratio(haystack, needle, at_least)
        return score and (score[0], 0, len(haystack))
    m, n = len(needle), len(haystack)
    code: dict[str, int] = {}
    h = np.array([code.setdefault(c, len(code)) for c in haystack], dtype=np.int64)
    need = np.zeros(len(code), dtype=np.int64)
    for c in needle:
        if c in code:
            need[code[c]] += 1
    start = np.r_[np.zeros(m - 1, np.int64), np.arange(n - m + 1), np.arange(n - m + 1, n)]
    end = np.r_[np.arange(1, m), np.arange(m, n + 1), np.full(m - 1, n)]
    shared = np.zeros(len(start), dtype=np.int64)
    for c in np.flatnonzero(need):
        sums = np.r_[0, np.cumsum(h == c)]
        shared += np.minimum(sums[end] - sums[start], need[c])
    top = 200.0 * shared / (m + end - start)
    masks, best = _masks(needle), (at_least - 1e-9, n, n)
    for k in np.argsort(-top, kind="stable"):
        if top[k] < best[0] - 1e-9:
            break
        a, b = int(start[k]), int(end[k])
        score = 200.0 * _lcs(masks, haystack[a:b]) / (m + b - a)
        if score > best[0] + 1e-9 or (abs(score - best[0]) <= 1e-9 and (a, b) < best[1:]):
            best = (score, a, b)
    return best if best[1] < n else None


def locate(needle: str, haystack: str, ends: np.ndarray, threshold: float = 55.0) -> tuple[int, int, float] | None:
    """(first word, last word, score) of the best window, or None below the threshold or for empty texts."""
    found = partial_ratio(needle, haystack, threshold)
    return found and (word_of_char(ends, found[1]), word_of_char(ends, found[2] - 1), found[0])


def locate_long(needle: str, haystack: str, ends: np.ndarray, threshold: float = 55.0, max_length: int = 300) -> tuple[int, int, float] | None:
    """locate(), but of a needle longer than 2 * max_length the head and the tail, each max_length, on their own; their mean score."""
    whole = 2 * max_length >= len(needle)
    if whole:
        return locate(needle, haystack, ends, threshold)
    head = locate(needle[:max_length], haystack, ends, threshold)
    tail = head and locate(needle[-max_length:], haystack, ends, threshold)
    if not head or not tail or head[0] > tail[1]:
        return None
    return head[0], tail[1], (head[2] + tail[2]) / 2


MATCH = [T.StructField("start_index", T.IntegerType()), T.StructField("end_index", T.IntegerType()), T.StructField("score", T.DoubleType())]


def fuzzy_locate(pairs: DataFrame, keys: Sequence[str], needle: str = "needle", haystack: str = "haystack", ends: str | None = "ends", threshold: float = 55.0, max_length: int | None = None) -> DataFrame:
    """keys, start_index, end_index, score for each pair of needle and haystack that matches; max_length splits long needles.

    Without `ends` the haystack is an array of words, which are joined here.
    """
    names = list(keys)
    hay = [F.col(haystack).alias("__h"), F.col(ends).cast("array<int>").alias("__e")] if ends else [F.array_join(haystack, "").alias("__h"), F.transform(haystack, lambda w: F.length(w)).alias("__e")]
    slim = pairs.select(*names, F.col(needle).alias("__n"), *hay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (n, h, e) in enumerate(zip(batch.column("__n").to_pylist(), batch.column("__h").to_pylist(), batch.column("__e").to_pylist())):
                if n and h and e:
                    e = np.asarray(e) if ends else np.cumsum(e)
                    found = locate_long(n, h, e, threshold, max_length) if max_length else locate(n, h, e, threshold)
                    if found:
                        rows.append((i, *found))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(cols[0], pa.int64())) for c in names), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())],
                names=[*names, *(f.name for f in MATCH)],
            )

    return slim.mapInArrow(run, T.StructType([slim.schema[k] for k in names] + MATCH))


def candidate_pairs(needles: DataFrame, hays: DataFrame, needle_key: str, hay_key: str, needle: str = "needle", haystack: str = "haystack", shingle: int = 4, least: float = 0.25, broadcast: bool = True) -> DataFrame:
    """Pairs of needle and haystack that share at least `least` of the needle's word shingles: (needle_key, hay_key, shared).

    An exact-scoring step needs only these.  Both sides are reduced to distinct
    64-bit shingle names before the join.  The needles' names go to all machines
    (`broadcast`, for needles that are few beside the haystacks): names that no
    needle has are dropped where they are made and never travel.
    """

    def names(df: DataFrame, key: str, text: str) -> DataFrame:
        words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
        x = df.select(key, words.alias("__w"))
        at = F.sequence(F.lit(1), F.greatest(F.size("__w") - shingle + 1, F.lit(1)))
        return x.select(key, F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("__w", i, shingle))))).alias("__g"))

    n = names(needles, needle_key, needle)
    size = n.groupBy(needle_key).agg(F.count("*").alias("__size"))
    h = names(hays, hay_key, haystack)
    shared = (F.broadcast(n) if broadcast else n).join(h, "__g").groupBy(needle_key, hay_key).agg(F.count("*").alias("shared"))
    return shared.join(size, needle_key).where(F.col("shared") >= F.greatest(F.lit(1.0), F.col("__size") * least)).drop("__size")
