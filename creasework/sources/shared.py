"""Intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isDefined():
            return java.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """As settle, in buckets by a key: joins of such tables on the key, and groups and windows within it, move no rows.

    Each task writes one file where df lies in as many partitions by the key already (``repartition``).
    """
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{checkpoint_dir(spark)}/{own}").bucketBy(buckets, by).saveAsTable(own)
    return spark.table(own)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of the files of a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def stamp(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells whether files changed: each one's length and time of modification."""
    found = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found.append((path, files.getContentSummary(where).getLength(), files.getFileStatus(where).getModificationTime()))
    return tuple(found)
