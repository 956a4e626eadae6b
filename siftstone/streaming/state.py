"""Keyed state over streams.

Each function takes a streaming DataFrame and returns one; `run_available` drives a stream over what is there
and returns its result as a table. Events of a key are folded in time order within a batch; across
batches the state carries on. Checkpoints and results live in the shared folder of the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.analytics import BURST, LIMIT, WINDOW_SECONDS
from ..sources.scratch import folder

MEMORY, MEMORY_SECONDS = 10, 1800
#: Events of a key that leave the fold at once.
FOLD_ROWS = 10_000


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table, one file or a folder, as a stream; a path in the form of a pattern may be a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(stream: DataFrame, complete: bool = False) -> DataFrame:
    """All that is there now, run to its end; with `complete` each batch replaces the result of the one before."""
    spark, place = stream.sparkSession, folder(stream.sparkSession, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    if complete:
        writer = writer.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/result"))
        writer.start().awaitTermination()
    else:
        writer.outputMode("append").format("parquet").option("path", f"{place}/result").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/result")


def session_counts(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    df = stream.select(key, F.col(ts).cast("timestamp").alias("_t")).withWatermark("_t", late)
    s = F.session_window("_t", gap)
    return df.groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def _forget_at(state: GroupState, last_ms: int, idle_ms: int) -> None:
    state.setTimeoutTimestamp(max(last_ms + idle_ms, state.getCurrentWatermarkMs() + 1))


def rate_limited(stream: DataFrame, key: str, ts: str, event_id: str, limit: float = LIMIT, window: float = WINDOW_SECONDS, burst: float = BURST, idle_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """(key, event id, allowed, tokens, retry_after) under a token bucket; a key idle for an hour of event time is forgotten."""
    fill = limit / window
    rows = stream.select(F.col(key).alias("k"), F.col(event_id).alias("e"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    kinds = dict(rows.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (limit, -1.0)
        # of each frame only the ids and the times stay: sixteen bytes a row
        ids, times = [], []
        for frame in frames:
            ids.append(frame["e"].to_numpy())
            times.append(frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64))
        ids, times = np.concatenate(ids), np.concatenate(times)
        order = np.lexsort((ids, times))
        for lo in range(0, len(order), FOLD_ROWS):
            out = []
            for k in order[lo : lo + FOLD_ROWS].tolist():
                t = float(times[k]) / 1e6
                tokens = min(burst, tokens + max(0.0, t - last) * fill) if last >= 0 else tokens
                last = max(t, last)
                if tokens >= 1.0:
                    tokens -= 1.0
                    out.append((k, True, tokens, 0.0))
                else:
                    out.append((k, False, tokens, (1.0 - tokens) / fill))
            at, allowed, left, wait = zip(*out, strict=True)
            yield pd.DataFrame({"k": key[0], "e": ids[list(at)], "allowed": allowed, "tokens": left, "retry_after": wait})
        state.update((float(tokens), float(last)))
        _forget_at(state, int(last * 1000), idle_ms)

    schema = f"k {kinds['k']}, e {kinds['e']}, allowed boolean, tokens double, retry_after double"
    out = rows.groupBy("k").applyInPandasWithState(run, schema, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("k").alias(key), F.col("e").alias(event_id), "allowed", "tokens", "retry_after")


def conversation_memory(stream: DataFrame, key: str, order: str, role: str, text: str, size: int = MEMORY, ts: str | None = None, idle_ms: int = MEMORY_SECONDS * 1000, late: str = "1 hour") -> DataFrame:
    """(key, messages, orders): the last messages of a conversation after each batch, oldest first.

    With a time column, a conversation idle for half an hour of event time is forgotten.
    """
    rows = stream.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.concat_ws(": ", role, text).alias("m"), *([F.col(ts).cast("timestamp").alias("ts")] if ts else []))
    rows = rows.withWatermark("ts", late) if ts else rows
    kinds = dict(rows.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = list(zip(*state.get, strict=True)) if state.exists else []
        held, latest = old, 0
        for new in frames:
            held = sorted([*held, *zip(new["o"].tolist(), new["m"].tolist(), strict=True)])[-size:]
            latest = max(latest, int(new["ts"].max().timestamp() * 1000)) if ts else 0
        state.update(([x[0] for x in held], [x[1] for x in held]))
        if ts:
            _forget_at(state, latest, idle_ms)
        yield pd.DataFrame({"k": [k[0]], "messages": [[x[1] for x in held]], "orders": [[x[0] for x in held]]})

    kind = GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout
    out = rows.groupBy("k").applyInPandasWithState(run, f"k {kinds['k']}, messages array<string>, orders array<bigint>", "o array<bigint>, m array<string>", "append", kind)
    return out.select(F.col("k").alias(key), "messages", "orders")


def latest_votes(stream: DataFrame, target: str, user: str, vote: str, order: str) -> DataFrame:
    """(target, user, vote): each user's latest vote, for complete mode; counts are sums over it."""
    return stream.groupBy(target, user).agg(F.max_by(vote, order).alias(vote))


def reaction_counts(stream: DataFrame, target: str, user: str, emoji: str, own: int) -> DataFrame:
    """(target, ups, downs), for complete mode: every thumb that others add counts, repeats too."""
    rows = stream.where(F.col(emoji).isin("👍", "👎") & (F.col(user) != own))
    return rows.groupBy(target).agg(F.count_if(F.col(emoji) == "👍").alias("ups"), F.count_if(F.col(emoji) == "👎").alias("downs"))


def repeated_dropped(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """A stream without exact repeats of a key within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
