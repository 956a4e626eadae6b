"""Ingestion of a source tree as a stream of notices.

A notice names a listing: a table of (path, text) of the whole tree at one time. Each micro-batch takes the listings that it
names in order, compares them with the last record by content hash, validates and chunks what is new or changed, and writes one
record of the batch. A record is a folder by batch number, so a batch that runs again after a failure finds the same
record before it and writes the same once more; readers take finished records only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..sources.scratch import folder

RECORD = "path string, state string, faults array<string>, hash string, document_id string, chunks long, source string, settings string, run long"
#: Namespace of document ids by path (the URL namespace of RFC 4122).
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@dataclass
class Ingestion:
    """State of one source tree in a folder; `settings` names all that shapes what is stored of a file.

    Files are new, changed, unchanged, removed (no longer listed) or invalid. An invalid file keeps what was recorded of it before, so
    it is looked at again. Other settings than the recorded ones begin anew; another source is refused unless `rebuild`.
    """

    spark: SparkSession
    path: str
    source: str
    settings: str = "1"
    level: int = 2
    rebuild: bool = False

    def _numbers(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            return []
        done = [x.getPath() for x in store.listStatus(at) if x.getPath().getName().startswith("batch=")]
        return sorted(int(x.getName()[6:]) for x in done if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def record(self, number: int) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(f"{self.path}/batch={number:012d}")

    def states(self) -> DataFrame:
        """All records: what each run has found of each file."""
        numbers = self._numbers()
        return self.spark.read.schema(RECORD).parquet(*(f"{self.path}/batch={n:012d}" for n in numbers)) if numbers else self.spark.createDataFrame([], RECORD)

    def _before(self, number: int) -> DataFrame:
        """Files that the record before a batch holds, of its last run."""
        earlier = [n for n in self._numbers() if n < number]
        if not earlier:
            return self.spark.createDataFrame([], RECORD)
        last = self.record(earlier[-1])
        run = last.agg(F.max("run")).first()[0]
        return last.where(F.col("run") == run)

    def _kept(self, before: DataFrame) -> DataFrame:
        """What still counts of a record; checks that it is of this source."""
        known = before.select("source", "settings").limit(1).collect()
        if known and known[0].source != self.source and not self.rebuild:
            raise ValueError(f"the record is of {known[0].source} and not of {self.source}")
        fresh = bool(known) and (known[0].source != self.source or known[0].settings != self.settings)
        return before.where(F.col("hash").isNotNull() & (F.col("state") != "removed") & ~F.lit(fresh)).select("path", F.col("hash").alias("_hash"), F.col("document_id").alias("_id"), F.col("chunks").alias("_chunks"))

    def run(self, listing: DataFrame, before: DataFrame, number: int) -> DataFrame:
        """The record of one listing; of a path that is listed twice the greatest text counts."""
        files = listing.groupBy("path").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).withColumn("hash", F.sha2("text", 256))
        both = files.join(self._kept(before), "path", "full")
        moved = F.when(F.col("hash").isNull(), "removed").when(F.col("_hash").isNull(), "new").when(F.col("hash") == F.col("_hash"), "unchanged").otherwise("changed")
        told = chunking.validated(both.withColumn("state", moved), "text")
        ingest = F.col("state").isin("new", "changed")
        told = told.withColumn("faults", F.when(ingest, F.col("faults")).otherwise(F.array().cast("array<string>"))).withColumn("state", F.when(ingest & (F.size("faults") > 0), "invalid").otherwise(F.col("state")))
        fresh = F.col("state").isin("new", "changed")
        own = chunking.chunk_count(F.when(fresh, F.col("text")), self.level)
        return told.select(
            "path", "state", "faults",
            F.when(F.col("state") != "removed", F.when(fresh, F.col("hash")).otherwise(F.col("_hash"))).alias("hash"),
            F.coalesce("_id", F.when(fresh, T.uuid5(NAMESPACE, F.col("path")))).alias("document_id"),
            F.when(F.col("state") != "removed", F.when(fresh, own).otherwise(F.col("_chunks"))).cast("long").alias("chunks"),
            F.lit(self.source).alias("source"), F.lit(self.settings).alias("settings"), F.lit(number).cast("long").alias("run"),
        )

    def apply(self, notices: DataFrame, number: int) -> None:
        """One micro-batch of notices (run, listing): few rows, each of them one look at the whole tree."""
        before, parts = self._before(number), []
        for notice in notices.orderBy("run").collect():
            before = self.run(self.spark.read.parquet(notice.listing), before, notice.run)
            parts.append(before)
        if parts:
            out = parts[0]
            for x in parts[1:]:
                out = out.unionByName(x)
            out.write.mode("overwrite").parquet(f"{self.path}/batch={number:012d}")

    def ingest(self, notices: DataFrame, checkpoint: str | None = None) -> None:
        """Run a stream of notices to the end of what is there."""
        place = checkpoint or folder(self.spark, "stream")
        notices.writeStream.option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(self.apply).start().awaitTermination()


def notices(spark: SparkSession, path: str) -> DataFrame:
    """Notices as a stream, a JSON file each, oldest first."""
    return spark.readStream.schema("run long, listing string").option("maxFilesPerTrigger", 1).json(path)


def split(files: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid files of a scan, the latter with their faults; one rule for both, so each file is in one of them."""
    told = chunking.validated(files, text_col)
    return told.where(F.size("faults") == 0).drop("faults", "has_front"), told.where(F.size("faults") > 0).drop("has_front")
