"""Column expressions for audio frames, logits, slices and durations (all seconds are doubles, frames longs)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
#: kernel widths and strides of the usual convolutional feature extractor
KERNELS = (10, 3, 3, 3, 3, 2, 2)
STRIDES = (5, 2, 2, 2, 2, 2, 2)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: inside a lambda of another function an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def seconds_to_frames(seconds: Column | str, sample_rate: int = SAMPLE_RATE) -> Column:
    """Whole frames in a duration, cut towards zero."""
    return (_col(seconds) * F.lit(sample_rate)).cast("long")


def receptive_field(kernels: Sequence[int] = KERNELS, strides: Sequence[int] = STRIDES) -> int:
    """Frames that one logit sees: a fold over the layers, known when the plan is made."""
    field, _ = reduce(lambda acc, layer: (acc[0] + (layer[0] - 1) * acc[1], acc[1] * layer[1]), zip(kernels, strides), (1, 1))
    return field


def rounded(x: Column | str, digits: int) -> Column:
    """half_up() of a column: Spark's own round takes halves of the decimal text, which SQL's round of DOUBLE doesn't see."""
    y = _col(x) * F.lit(10.0**digits)
    size = F.abs(y)
    whole = F.floor(size).cast("double")
    return F.signum(y) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as SQL's round of DOUBLE: halves of the scaled number away from zero."""
    y = x * 10.0**digits
    whole = np.trunc(y)
    return (whole + (np.abs(y - whole) >= 0.5) * np.sign(y)) / 10.0**digits


def receptive_field_of(kernels: Column | str, strides: Column | str) -> Column:
    """The same fold for kernels and strides that are array columns."""
    layers = F.zip_with(_col(kernels), _col(strides), lambda k, s: F.struct(k.cast("long").alias("k"), s.cast("long").alias("s")))
    start = F.struct(F.lit(1).cast("long").alias("field"), F.lit(1).cast("long").alias("step"))
    return F.aggregate(layers, start, lambda a, x: F.struct((a.field + (x.k - 1) * a.step).alias("field"), (a.step * x.s).alias("step"))).field


def logits(frames: Column | str, kernels: Sequence[int] = KERNELS, strides: Sequence[int] = STRIDES, adapter_layers: int = 0, adapter_stride: int = 2) -> Column:
    """Logits of one window of frames; fewer frames than the receptive field count as that many."""
    n = F.greatest(_col(frames).cast("long"), F.lit(receptive_field(kernels, strides)).cast("long"))
    for k, s in zip(kernels, strides):
        n = F.floor((n - k) / s) + 1
    for _ in range(adapter_layers):
        n = F.floor((n - 1) / adapter_stride) + 1
    return n.cast("long")


def output_logits(frames: Column | str, chunk_size: float = 30, sample_rate: int = SAMPLE_RATE, **model) -> Column:
    """Logits of frames that are fed in chunks of chunk_size seconds: whole chunks, then the rest."""
    frames = _col(frames).cast("long")
    whole = int(chunk_size * sample_rate)
    rest = frames % whole
    return F.floor(frames / whole).cast("long") * logits(F.lit(whole), **model) + F.when(rest > 0, logits(rest, **model)).otherwise(F.lit(0)).cast("long")


def with_num_logits(chunks: DataFrame, frames_col: str = "audio_frames", chunk_size: float = 30, **model) -> DataFrame:
    """Adds num_logits; null where the frames are unknown."""
    return chunks.withColumn("num_logits", F.when(F.col(frames_col).isNotNull(), output_logits(frames_col, chunk_size, **model)))


def duration(start: Column | str, end: Column | str, known: Column | str | None = None) -> Column:
    """end - start where no duration is known."""
    d = _col(end) - _col(start)
    return d if known is None else F.coalesce(_col(known), d)


def chunk_record(start: Column | str, end: Column | str, sample_rate: int = SAMPLE_RATE) -> Column:
    """Struct of a detected chunk: start, end, duration, audio_frames."""
    start, end = _col(start), _col(end)
    return F.struct(start.alias("start"), end.alias("end"), (end - start).alias("duration"), seconds_to_frames(end - start, sample_rate).alias("audio_frames"))


def speech_slices(speeches: DataFrame, chunk_size: float = 30, sample_rate: int = SAMPLE_RATE, start_col: str = "start", end_col: str = "end") -> DataFrame:
    """One row per slice of chunk_size seconds of each [start, end); the last is shorter. Adds slice_pos, start_sec, end_sec, audio_frames.

    A null or non-positive duration gives no slice.
    """
    length = F.col(end_col) - F.col(start_col)
    pieces = F.ceil(length / chunk_size).cast("int")
    k = F.explode(F.sequence(F.lit(0), pieces - 1))
    return (
        speeches.where(length > 0)
        .select("*", k.alias("slice_pos"))
        .withColumn("start_sec", F.col(start_col) + F.col("slice_pos") * F.lit(float(chunk_size)))
        .withColumn("end_sec", F.least(F.col(start_col) + (F.col("slice_pos") + 1) * F.lit(float(chunk_size)), F.col(end_col)))
        .withColumn("audio_frames", seconds_to_frames(F.col("end_sec") - F.col("start_sec"), sample_rate))
    )


def chunk_slices(speeches: DataFrame, chunks_col: str = "chunks", sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """One row per detected chunk of a speech: slice_pos, start_sec, end_sec, audio_frames."""
    chunk = F.col("__chunk")
    return (
        speeches.select(*[c for c in speeches.columns if c != chunks_col], F.posexplode(chunks_col).alias("slice_pos", "__chunk"))
        .withColumn("start_sec", chunk.start)
        .withColumn("end_sec", chunk.end)
        .withColumn("audio_frames", seconds_to_frames(chunk.end - chunk.start, sample_rate))
        .drop("__chunk")
    )


def speech_id_or_position(speech_id: Column | str, position: Column | str) -> Column:
    return F.coalesce(_col(speech_id).cast("string"), _col(position).cast("string"))


def pad_to(values: Column | str, size: int | Column, fill: float = 0.0) -> Column:
    """Right-pads an array; longer ones stay."""
    values = _col(values)
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), size - F.size(values)).cast("int")))


def pad_exactly(values: Column | str, size: int | Column, fill: float = 0.0) -> Column:
    """pad_to, and an error for an array longer than the size."""
    values = _col(values)
    limit = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(values) > limit, F.raise_error(F.lit("more values than the size to pad to"))).otherwise(pad_to(values, size, fill))


def softmax(values: Column | str) -> Column:
    """Probabilities of an array of scores, the greatest subtracted first; summed in order, in double."""
    shares = lambda e: let(F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return let(
        F.transform(_col(values), lambda x: x.cast("double")),
        lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), shares)),
    )


def timestamp_text(seconds: Column | str) -> Column:
    """hh:mm:ss,mmm, every part cut towards zero."""
    s = _col(seconds)
    whole = F.floor(s).cast("long")
    ms = F.floor((s - whole) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long"), whole % 60, ms)


def round_half(value: Column | str, digits: int = 5) -> Column:
    return F.round(_col(value), digits)
