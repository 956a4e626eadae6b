"""Query op9: suffix-array dedup of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, suffix_dedup


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.table(spark, sf_dir, "documents"), form="sha256")
