"""Spark helpers of the subpackage: shared folder, written tables, safe column use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from chronotext.sources.tables import read_table


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see, from spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: compressed, and read again column by column.

    scratch gets the table's path, for removed() when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables of written(); what was made from them must be written by then."""
    conf = spark._jsc.hadoopConfiguration()
    while scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, spread=name == "documents")
