"""Query op13: whitening of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, whitening


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long can hold (from some five million vectors on) is null; whiten() has it as a decimal."""
    return whitening.whiten(common.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
