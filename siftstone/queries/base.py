"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.sizes import spread

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: Tables whose rows cost much more to work on than to move.
TEXTS = ("documents",)


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return spread(df) if name in TEXTS else df


def query(sql: str | None = None):
    """Register a function of Tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]):
        REGISTRY[f.__name__] = (lambda spark, folder: f(Tables(spark, folder)), sql)
        return f

    return register
