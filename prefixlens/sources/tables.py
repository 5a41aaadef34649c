"""Parquet tables and tables written in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The setting that names it.
SHARED_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one only where none is named."""
    named = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR)
    if not named:
        named = os.path.join(tempfile.gettempdir(), f"prefixlens-{os.getuid()}")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED_DIR} to a folder that all executors share")
    return named.rstrip("/")


_written: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts the lineage, survives lost executors.

    Unlike checkpoint() the copy is columnar, so later readers fetch only the columns they need. The table
    stays until ``drop_written`` or the end of the driver's JVM, as lazy results read it.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    files, at = hadoop_path(df.sparkSession, path)
    files.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def last_written() -> str:
    """The path of the table written last."""
    return _written[-1]


def drop_written(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete all tables this process has written, or these; results still reading them are lost. Returns how many."""
    gone = list(_written if paths is None else paths)
    for p in gone:
        _written.remove(p)
        files, at = hadoop_path(spark, p)
        files.delete(at, True)
    return len(gone)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for stages that work hard on each row.

    Few large files (or one row group) read as fewer partitions than there are cores; only then are rows
    moved. On a large table every core has splits of its own and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that stages over wide rows work on at a time.
PIECE = 256


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time: Python objects of a whole batch of wide rows would fill an executor."""
    for b in batches:
        for i in range(0, b.num_rows, PIECE):
            yield b.slice(i, PIECE)
