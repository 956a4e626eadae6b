"""Query op5: quality of whole documents, learned from two thirds of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, factorisation


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, x) for x in ("documents", "labels"))
    held_out = common.bucket(F.col("doc_id"), 3) == 1
    machine = factorisation.fit(docs, labels, "quality", ~held_out)
    return factorisation.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
