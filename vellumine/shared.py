"""Intermediate tables: the folder that driver and executors share, and lineage cuts through it."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local one
    is made in local mode only: elsewhere no such folder would be shared."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = Path(tempfile.mkdtemp(prefix="vellumine-shared-")).as_uri()
        _own[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def _of(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared one; whatever it holds goes when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    store, where = _of(spark, path)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    store, where = _of(spark, path)
    store.delete(where, True)


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Cut lineage: write a table into the shared folder and read it back with the same schema; and its path."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return stored(df, tag)[0]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
