"""Conversation memory as state with timers of its own.

A key holds its last messages and one event-time timer. Rows of a key are folded frame by frame into the few that
are kept, whatever order they come in, so a key of any size takes bounded memory. Once the watermark has passed a key's
last message by the idle time its state is deleted; a message after that begins a new memory, as it
would if the state were still there: messages before a pause of more than the idle time never count.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import folder
from .state import MEMORY, MEMORY_SECONDS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = "at long, id long, message string"


def latest(messages: list[tuple], size: int, idle_us: int) -> list[tuple]:
    """The last messages (at, id, text), oldest first, after the last pause of more than the idle time."""
    held = sorted(messages)[-size:]
    cut = max((k for k in range(1, len(held)) if held[k][0] - held[k - 1][0] > idle_us), default=0)
    return held[cut:]


class Memory(StatefulProcessor):
    """Emits (k, expired, at, messages) after each batch of a key, and once more when it is forgotten."""

    def __init__(self, size: int, idle_us: int):
        self.size, self.idle_us = size, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.held.get()]
        for frame in rows:
            held = sorted([*held, *zip(frame["at"].tolist(), frame["id"].tolist(), frame["message"].tolist(), strict=True)])[-self.size :]
        self.held.put(held)  # a pause is cut off only in what is told, as later rows may still fill it
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((held[-1][0] + self.idle_us) // 1000)
        yield pd.DataFrame({"k": [key[0]], "expired": [False], "at": [held[-1][0]], "messages": [[x[2] for x in latest(held, self.size, self.idle_us)]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.held.get()]
        self.held.clear()
        yield pd.DataFrame({"k": [key[0]], "expired": [True], "at": [held[-1][0] if held else None], "messages": [[x[2] for x in latest(held, self.size, self.idle_us)]]})

    def close(self) -> None:
        pass


def memory(stream: DataFrame, key: str, ts: str, order: str, role: str, text: str, size: int = MEMORY, idle_seconds: int = MEMORY_SECONDS, late: str = "1 hour") -> DataFrame:
    """(key, expired, at, messages): the last messages of each key since its last half hour's pause, after each batch and when it is forgotten."""
    t = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(key).alias("k"), t.alias("ts"), F.unix_micros(t).alias("at"), F.col(order).cast("long").alias("id"), F.concat_ws(": ", role, text).alias("message")).withWatermark("ts", late)
    kind = dict(rows.dtypes)["k"]
    out = rows.groupBy("k").transformWithStateInPandas(Memory(size, idle_seconds * 1_000_000), f"k {kind}, expired boolean, at long, messages array<string>", "append", "EventTime")
    return out.select(F.col("k").alias(key), "expired", "at", "messages")


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """State with timers needs this store; the setting is read when a stream starts and put back after."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def run_available(stream: DataFrame) -> DataFrame:
    """All that is there now, run to its end; the emitted rows with the number of their `batch`."""
    spark, place = stream.sparkSession, folder(stream.sparkSession, "stream")

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/result/n={number}")

    with rocksdb(spark):
        stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).outputMode("append").foreachBatch(write).start().awaitTermination()
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{names}, batch long").parquet(f"{place}/result/n=*")
