"""Tables that are written in between, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="siftstone-")


def folder(spark: SparkSession, kind: str = "table") -> str:
    """A new name under spark.checkpoint.dir; under a local folder only where that is unset and the master is local.

    What is written there goes when the driver's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def saved(df: DataFrame) -> DataFrame:
    """The table, written once and read back; a lost executor costs no more than the reading."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
