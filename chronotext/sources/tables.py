"""Tables of a folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: an input of fewer files than cores is spread over them if it has no more bytes than this
SPREAD_BYTES = 256 << 20


def read_table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """<folder>/<name>.parquet.

    With spread, a small table in few files is dealt out to all cores, so that
    maps over it run side by side; its size is looked up first, and a large one is
    read as it is: its splits are parallel already.
    """
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and len(df.inputFiles()) < cores:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() <= SPREAD_BYTES:
            return df.repartition(cores)
    return df
