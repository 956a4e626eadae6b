"""Joins whose plan depends on a checked size, and ranks that no single task computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side of at most so many rows is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Ranges that a key's values are cut into when they are ranked.
RANGES = 1024


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A table of fewer bytes for each core is dealt out anew before work on its texts.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """The table, dealt over all cores if it is small: a file of one row group is one task, however many cores there are.

    Tables of SPREAD_BYTES a core and more have enough row groups and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES * cores else df


def blocks_of(df: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """The table in broadcast blocks of about `rows` rows each."""
    n = max(1, -(-df.count() // rows))
    return [F.broadcast(df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)) for k in range(n)]


def placed(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """Adds `before`: the summed weight of the key's rows with a smaller value. Values of a key are distinct numbers.

    Each key's values are cut into RANGES equal ranges; sums go over the ranges, one window inside
    each of them, so a key of any size is dealt to as many tasks.
    """
    rows = df.withColumn("_w", weight)
    low = rows.groupBy(*keys).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    share = (F.col(value).cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    cut = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(low, keys).withColumn("_range", cut).drop("_low", "_high")
    sums = rows.groupBy(*keys, "_range").agg(F.sum("_w").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_inside", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return within.join(sums, [*keys, "_range"]).withColumn("before", F.col("_earlier") + F.col("_inside")).drop("_w", "_range", "_inside", "_earlier")
