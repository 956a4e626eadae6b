"""The registered queries of the library, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession

from .base import REGISTRY

for _m in iter_modules(__path__):
    if _m.name != "base":
        import_module(f"{__name__}.{_m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
