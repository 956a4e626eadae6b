"""Query op1: fingerprints of whole documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, fingerprints


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(common.table(spark, sf_dir, "documents"))
