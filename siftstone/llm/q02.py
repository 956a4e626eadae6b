"""Query op2: language of whole documents, learned from four fifths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, language


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    known = language.profiles(docs, common.bucket(F.col("doc_id"), 5) != 0)
    found = language.identify(docs, known)
    return found.select("doc_id", (common.bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
