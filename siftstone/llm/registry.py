"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession

import siftstone.llm as package


MODULES = [import_module(f"{package.__name__}.{m.name}") for m in iter_modules(package.__path__) if m.name.startswith("q") and m.name[1:].isdigit()]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in MODULES if getattr(m, "SQL", None)}
