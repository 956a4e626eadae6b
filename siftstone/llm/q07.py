"""Query op7: quality rules over whole documents; documents labelled good are the trusted target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality_rules


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    return quality_rules.judge(common.table(spark, sf_dir, "documents"), trusted)
