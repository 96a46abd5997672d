"""Intervals from scores: hysteresis regions, min-cut, merging, packing into chunks of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hysteresis_regions(scores: DataFrame, keys: Sequence[str], ts: str = "ts", score: str = "score", onset: float = 0.5, offset: float | None = None) -> DataFrame:
    """Regions (keys, region, start, end) that begin where the score exceeds onset and end at the first one below offset.

    Gaps and islands over ordered windows: the last crossing decides the state.
    A region that is open at the end closes with the last score.  An offset of 0
    or none is the onset; offset <= onset is needed.
    """
    offset = offset or onset
    if offset > onset:
        raise ValueError("offset exceeds onset: use mincut_regions, which runs the state machine itself")
    s = scores.select(*keys, F.col(ts).alias("__t"), F.when(F.col(score) > onset, 1).when(F.col(score) < offset, 0).alias("__cross"))
    w = Window.partitionBy(*keys).orderBy("__t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("__on", F.coalesce(F.last("__cross", ignorenulls=True).over(upto), F.lit(0)))
    s = s.withColumn("__opens", ((F.col("__on") == 1) & (F.coalesce(F.lag("__on").over(w), F.lit(0)) == 0)).cast("int"))
    s = s.withColumn("region", F.sum("__opens").over(upto).cast("int") - 1)
    # the closing score belongs to the region it ends
    s = s.withColumn("__closes", (F.col("__on") == 0) & (F.coalesce(F.lag("__on").over(w), F.lit(0)) == 1))
    return s.where((F.col("__on") == 1) | F.col("__closes")).groupBy(*keys, "region").agg(F.min("__t").alias("start"), F.max("__t").alias("end"))


def _machine(times, values, onset: float, offset: float, longest: float) -> list[tuple[float, float]]:
    """State machine of one series with a cut at the lowest score of the buffer's second half when a region gets too long.

    The buffer keeps what was pushed since the last closing sign, that one
    included, and never the score that opened the region; after a cut the same
    score isn't tested for closing.
    """
    out: list[tuple[float, float]] = []
    if not len(times):
        return out
    begun, on = times[0], values[0] > onset
    buffer = [(values[0], times[0])]
    for t, y in zip(times[1:], values[1:]):
        if not on:
            if y > onset:
                begun, on = t, True
            continue
        if t - begun > longest:
            half = len(buffer) // 2
            low = min(range(half, len(buffer)), key=lambda k: buffer[k][0])
            out.append((begun, buffer[low][1]))
            begun = buffer[low][1]
            del buffer[: low + 1]
        elif y < offset:
            out.append((begun, t))
            begun, on = t, False
            buffer.clear()
        buffer.append((y, t))
    if on:
        out.append((begun, times[-1]))
    return out


def mincut_regions(scores: DataFrame, keys: Sequence[str], ts: str = "ts", score: str = "score", onset: float = 0.5, offset: float | None = None, max_duration: float = 30.0) -> DataFrame:
    """hysteresis_regions with no region much longer than max_duration: each cut changes all later states, so the series is folded in order."""
    limit, schema = offset or onset, T.StructType([scores.schema[k] for k in keys] + [T.StructField("region", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
    names = list(keys)

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__t", kind="stable")
        found = _machine(rows["__t"].tolist(), rows["__y"].tolist(), onset, limit, max_duration)
        return pd.DataFrame([(*key, k, a, b) for k, (a, b) in enumerate(found)], columns=[*names, "region", "start", "end"])

    slim = scores.select(*keys, F.col(ts).cast("double").alias("__t"), F.col(score).cast("double").alias("__y"))
    return slim.groupBy(*keys).applyInPandas(fold, schema)


def merge_intervals(intervals: DataFrame, keys: Sequence[str], pad_on: float = 0.0, pad_off: float = 0.0, min_off: float = 0.0, min_on: float = 0.0, start: str = "start", end: str = "end") -> DataFrame:
    """Padded intervals, united where they overlap, touch or leave a gap shorter than min_off; shorter ones than min_on go.

    With no padding and no min_off nothing is united.  A running maximum of the
    ends over an ordered window; one exchange for windows and grouping.
    """
    x = intervals.select(*keys, (F.col(start) - pad_on).alias("start"), (F.col(end) + pad_off).alias("end"))
    if pad_on > 0 or pad_off > 0 or min_off > 0:
        w = Window.partitionBy(*keys).orderBy("start", "end")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        apart = reach.isNull() | ((F.col("start") > reach) & (F.col("start") - reach >= min_off))
        x = x.withColumn("__new", apart.cast("int")).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        x = x.groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")
    return x.where(F.col("end") - F.col("start") >= min_on) if min_on > 0 else x


def _pack(segments: Column, size: float, first_end: Column) -> Column:
    """Fold of ordered segments into chunks; the chunk under way is the accumulator's tail."""
    seg = "struct<start:double,end:double>"
    chunk = f"struct<start:double,end:double,segments:array<{seg}>>"
    zero = F.struct(
        F.expr(f"cast(array() as array<{chunk}>)").alias("done"),
        F.element_at(segments, 1).start.alias("start"),
        first_end.cast("double").alias("end"),
        F.expr(f"cast(array() as array<{seg}>)").alias("held"),
    )

    def step(acc: Column, s: Column) -> Column:
        flush = (s.end - acc.start > size) & (acc.end - acc.start > 0)
        done = F.when(flush, F.concat(acc.done, F.array(F.struct(acc.start.alias("start"), acc.end.alias("end"), acc.held.alias("segments"))))).otherwise(acc.done)
        empty = F.expr(f"cast(array() as array<{seg}>)")
        return F.struct(
            done.alias("done"),
            F.when(flush, s.start).otherwise(acc.start).alias("start"),
            s.end.alias("end"),
            F.concat(F.when(flush, empty).otherwise(acc.held), F.array(F.struct(s.start.alias("start"), s.end.alias("end")))).alias("held"),
        )

    return F.aggregate(segments, zero, step, lambda acc: F.concat(acc.done, F.array(F.struct(acc.start.alias("start"), acc.end.alias("end"), acc.held.alias("segments")))))


def pack_chunks(regions: DataFrame, keys: Sequence[str], chunk_size: float = 30.0, mode: str = "a", start: str = "start", end: str = "end") -> DataFrame:
    """Greedy packing of each key's regions into chunks of chunk_size seconds: keys, chunk_pos, start, end, segments.

    Mode "a" starts with an open end of 0; mode "b" with the first region's end,
    which emits a first region longer than the size twice, first without segments.
    """
    if mode not in ("a", "b"):
        raise ValueError("mode is a or b")
    listed = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end")))).alias("__r"))
    first_end = F.element_at("__r", 1).end if mode == "b" else F.lit(0.0)
    packed = listed.select(*keys, F.posexplode(_pack(F.col("__r"), float(chunk_size), first_end)).alias("chunk_pos", "__c"))
    return packed.select(*keys, "chunk_pos", "__c.start", "__c.end", "__c.segments")


def chunks_of_scores(scores: DataFrame, keys: Sequence[str], chunk_size: float = 30.0, onset: float = 0.5, offset: float | None = None, ts: str = "ts", score: str = "score") -> DataFrame:
    """Scores to chunks: min-cut regions no longer than the chunk size, then packing."""
    return pack_chunks(mincut_regions(scores, keys, ts, score, onset, offset, chunk_size), keys, chunk_size)


def detect_in_speeches(speeches: DataFrame, scores: DataFrame, file_key: str, speech_key: str, chunk_size: float = 30.0, onset: float = 0.5, offset: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Voice activity within given speeches: (speeches with start, end and duration filled, chunks of each speech).

    Scores are joined to the speech that contains them by file and time; times of
    chunks are those of the file.  A speech without a duration is narrowed to its
    first and last chunk.  An unknown start or end is open.
    """
    s = speeches.select(file_key, speech_key, F.col("start").alias("__a"), F.col("end").alias("__b"), F.col("duration").alias("__d"))
    inside = (F.coalesce(F.col("__a"), F.lit(float("-inf"))) <= F.col("ts")) & (F.col("ts") < F.coalesce(F.col("__b"), F.lit(float("inf"))))
    own = scores.join(s, file_key).where(inside)
    chunks = chunks_of_scores(own, [file_key, speech_key], chunk_size, onset, offset)
    ends = chunks.groupBy(file_key, speech_key).agg(F.min_by("start", "chunk_pos").alias("__first"), F.max_by("end", "chunk_pos").alias("__last"))
    narrowed = F.col("duration").isNull() & F.col("__first").isNotNull()
    filled = speeches.join(ends, [file_key, speech_key], "left")
    filled = filled.withColumn("start", F.when(narrowed, F.col("__first")).otherwise(F.col("start"))).withColumn("end", F.when(narrowed, F.col("__last")).otherwise(F.col("end")))
    return filled.withColumn("duration", F.coalesce("duration", F.col("end") - F.col("start"))).drop("__first", "__last"), chunks


def detect_in_files(scores: DataFrame, file_key: str, chunk_size: float = 30.0, onset: float = 0.5, offset: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Files without speeches: one speech from the first chunk's start to the last one's end, and its chunks."""
    chunks = chunks_of_scores(scores, [file_key], chunk_size, onset, offset).withColumn("speech_id", F.lit("0"))
    speeches = chunks.groupBy(file_key, "speech_id").agg(F.min_by("start", "chunk_pos").alias("start"), F.max_by("end", "chunk_pos").alias("end"))
    return speeches.withColumn("duration", F.col("end") - F.col("start")), chunks
