"""Nested files as JSON or MessagePack documents, one per audio file; emissions as Parquet."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.schema import FILE
from chronotext.sources import codec


def read_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Documents under the paths, by the fixed schema: no inference pass."""
    return spark.read.schema(FILE).option("multiLine", True).json(paths if isinstance(paths, str) else list(paths))


def read_msgpack(spark: SparkSession, path: str) -> DataFrame:
    """Documents in MessagePack: files are split over tasks and decoded there; an undecodable one has a row with an error and no record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    shape = T.StructType([T.StructField("path", T.StringType()), T.StructField("record", FILE), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        for batch in batches:
            rows = []
            for path_, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows.append({"path": path_, "record": codec.fit(codec.loads(content), FILE), "error": None})
                except (ValueError, IndexError, KeyError, TypeError) as e:
                    rows.append({"path": path_, "record": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, shape)


def output_name(audio_path: str, output_dir: str, suffix: str) -> str:
    """<output_dir>/<parent>/<stem><suffix>: files that differ only in their extension share it."""
    parent, name = os.path.split(audio_path)
    return os.path.join(output_dir, parent.lstrip("/"), os.path.splitext(name)[0] + suffix)


def _write_each(files: DataFrame, output_dir: str, suffix: str, encode) -> None:
    """One document per file, written by the tasks under a temporary name and then renamed, so that a repeated task does no harm."""

    def write(rows) -> None:
        for r in rows:
            path = output_name(r.audio_path, output_dir, suffix)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(encode(r.document))
            os.replace(part, path)

    document = F.to_json(F.struct(*files.columns), {"ignoreNullFields": "false"})
    files.select("audio_path", document.alias("document")).foreachPartition(write)


def write_json(files: DataFrame, output_dir: str, indent: int | None = 2) -> None:
    """<output_dir>/<parent>/<stem>.json for each file; indent=None writes one line. The folder must be one that all executors see."""
    import json

    _write_each(files, output_dir, ".json", lambda d: d.encode() if indent is None else json.dumps(json.loads(d), indent=indent, ensure_ascii=False).encode())


def write_msgpack(files: DataFrame, output_dir: str) -> None:
    import json

    _write_each(files, output_dir, ".msgpack", lambda d: codec.dumps(json.loads(d)))


def write_table(table: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Flat segments or words as Parquet."""
    table.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_emissions(emissions: DataFrame, path: str) -> DataFrame:
    """Frames (audio_path, speech_id, chunk_pos, frame, probs), one folder per speech; returns the table as read again."""
    emissions.repartition("audio_path", "speech_id").sortWithinPartitions("audio_path", "speech_id", "chunk_pos", "frame").write.mode("overwrite").partitionBy("audio_path", "speech_id").parquet(path)
    return emissions.sparkSession.read.schema(emissions.schema).parquet(path)


def speech_emissions(emissions: DataFrame, by_chunk: bool = False) -> DataFrame:
    """Frames in order as one array per speech (chunks stacked in time) or per chunk: column emission."""
    keys = ["audio_path", "speech_id", *(["chunk_pos"] if by_chunk else [])]
    listed = F.array_sort(F.collect_list(F.struct("chunk_pos", "frame", "probs")))
    return emissions.groupBy(*keys).agg(F.transform(listed, lambda x: x.probs).alias("emission"))


def drop_emissions(spark: SparkSession, path: str) -> None:
    """Deletes a table of emissions, through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of shape (chunks, frames, vocabulary) in .npy files as rows: path, chunk_pos, frame, probs."""
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[None] if a.ndim == 2 else a
                c, f, v = a.shape
                chunk, frame = np.divmod(np.arange(c * f), f)
                flat = pa.array(np.ascontiguousarray(a.reshape(-1)).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p] * (c * f)), pa.array(chunk.astype(np.int32)), pa.array(frame.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, c * f * v + 1, v), pa.int32()), flat)],
                    names=["path", "chunk_pos", "frame", "probs"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, chunk_pos int, frame int, probs array<float>")
