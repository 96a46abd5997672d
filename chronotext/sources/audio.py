"""Audio files: WAV headers and slices read by byte range; other formats through a decoder that the caller brings."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Decoder = Callable[[bytes, int], np.ndarray]


def decode_wav(content: bytes, sample_rate: int) -> np.ndarray:
    """Mono float samples in [-1, 1] at sample_rate; channels are averaged, other rates interpolated linearly."""
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float64) / 2147483648
    else:
        raise ValueError(f"{8 * width} bit samples")
    x = x.reshape(-1, channels).mean(axis=1)
    if rate != sample_rate and len(x):
        n = int(round(len(x) * sample_rate / rate))
        x = np.interp(np.arange(n) * rate / sample_rate, np.arange(len(x)), x)
    return x.astype(np.float32)


def audio_files(spark: SparkSession, path: str, sample_rate: int = 16_000, decoder: Decoder = decode_wav) -> DataFrame:
    """path, duration (seconds), frames, error of each file: a bad file has an error and no duration, and the others go on."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    n = len(decoder(c, sample_rate))
                    rows.append((p, n / sample_rate, n, None))
                except Exception as e:  # whatever a decoder raises is that file's error
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            a, b, c_, d = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c_, pa.int64()), pa.array(d, pa.string())], names=["path", "duration", "frames", "error"])

    return files.mapInArrow(run, "path string, duration double, frames long, error string")


def read_slice(path: str, start: float, end: float, sample_rate: int = 16_000) -> np.ndarray:
    """Samples of [start, end) of a WAV file, sought and not read through."""
    with wave.open(path, "rb") as w:
        a = max(0, int(start * w.getframerate()))
        w.setpos(min(a, w.getnframes()))
        raw = w.readframes(max(0, int(end * w.getframerate()) - a))
        out = io.BytesIO()
        with wave.open(out, "wb") as v:
            v.setparams(w.getparams())
            v.writeframes(raw)
    return decode_wav(out.getvalue(), sample_rate)


def read_slices(slices: DataFrame, path_col: str = "audio_path", start_col: str = "start_sec", end_col: str = "end_sec", sample_rate: int = 16_000, root: str = "") -> DataFrame:
    """Adds samples (array<float>) to each slice; every task reads only its slices. An unreadable slice has null samples and an error."""
    from pyspark.sql import types as T

    shape = T.StructType([*slices.schema.fields, T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, errors = [], []
            for p, a, b in zip(*(batch.column(c).to_pylist() for c in (path_col, start_col, end_col))):
                try:
                    samples.append(read_slice((root + p).removeprefix("file:"), a, b, sample_rate))
                    errors.append(None)
                except (OSError, EOFError, ValueError, wave.Error) as e:
                    samples.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.append_column("samples", pa.array(samples, pa.list_(pa.float32()))).append_column("error", pa.array(errors, pa.string()))

    return slices.mapInArrow(run, shape)


def file_records(files: DataFrame, sample_rate: int = 16_000) -> DataFrame:
    """audio_path, sample_rate, duration of the readable files."""
    return files.where("error is null").select(F.col("path").alias("audio_path"), F.lit(sample_rate).alias("sample_rate"), "duration")


def failed(expected: DataFrame, done: DataFrame, key: str = "audio_path") -> DataFrame:
    """What was to be done and wasn't: an anti-join on the key."""
    return expected.join(done.select(key), key, "left_anti")
