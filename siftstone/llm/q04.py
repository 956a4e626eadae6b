"""Query op4: toxicity of whole documents, learned from three quarters of the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, toxicity


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, x) for x in ("documents", "labels"))
    held_out = common.bucket(F.col("doc_id"), 4) == 2
    network = toxicity.fit(docs, labels, "toxic", ~held_out)
    return toxicity.score(docs, network).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
