"""Query op12: repair of all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, repair


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(common.table(spark, sf_dir, "conversations"))
