"""Tables as versions: every change writes a new folder and then moves a pointer.

Plain Parquet has no MERGE. An upsert is an anti-join and a union, a delete an anti-join; readers see the
version that the pointer names, so a failed write leaves the old one in place. All paths go through
Spark's file systems.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Base with the rows inserted, or put in place of those with their key."""
    return base.join(rows.select(key), key, "left_anti").unionByName(rows.toDF(*base.columns) if rows.columns != base.columns else rows)


def deleted(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def classify(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, state): new, removed, changed or unchanged."""
    both = old.select(key, F.col(content).alias("_old")).join(new.select(key, F.col(content).alias("_new")), key, "full")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return both.select(key, state.alias("state"))


class VersionedTable:
    """A folder of versions with a pointer table `_current` of one row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.path}/_current_pointer"

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._pointer())
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame:
        name = self.spark.read.text(self._pointer()).orderBy(F.desc("value")).first()["value"].split(" ")[1]
        return self.spark.read.parquet(f"{self.path}/{name}")

    def replace(self, df: DataFrame) -> None:
        """Write a version and then name it; the newest line of the pointer counts."""
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        number = self.spark.read.text(self._pointer()).count() if self.exists() else 0
        self.spark.createDataFrame([(f"{number:012d} {name}",)], "value string").coalesce(1).write.mode("append").text(self._pointer())

    def append(self, rows: DataFrame) -> None:
        self.replace(self.read().unionByName(rows) if self.exists() else rows)

    def upsert(self, rows: DataFrame, key: str) -> None:
        self.replace(upserted(self.read(), rows, key) if self.exists() else rows)

    def delete(self, keys: DataFrame, key: str) -> int:
        """How many rows went."""
        base = self.read()
        gone = base.join(keys.select(key), key, "left_semi").count()
        if gone:
            self.replace(deleted(base, keys, key))
        return gone

    def reset(self) -> None:
        self.replace(self.read().limit(0))
