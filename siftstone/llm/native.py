"""Shared DataFrame expressions of the operators that use built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_IDS = 4_000_000


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def rolling(array: str, width: int, make) -> Column:
    """make(item) for each place with `width` items; item(k) is the k-th from there."""
    last = F.size(array) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: make(lambda k: F.get(F.col(array), i + k)))).otherwise(F.array().cast("array<bigint>"))


def constants(values: list[float]) -> Column:
    """An array literal; Catalyst folds it once."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def marked(rows: DataFrame, on: str, ids: DataFrame, name: str) -> DataFrame:
    """Rows with the boolean `name`: whether `on` is among the distinct ids (column id).

    The ids are broadcast if there are at most BROADCAST_IDS of them, else joined by a shuffle.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    flags = ids.select("id", F.lit(True).alias(name))
    return rows.join(F.broadcast(flags) if few else flags, rows[on] == flags["id"], "left").drop("id").withColumn(name, F.coalesce(name, F.lit(False)))
