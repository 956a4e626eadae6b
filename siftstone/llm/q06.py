"""Query op6: packing of whole documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common, packing

WORDS = "word_bpe_49k.json"


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), with_ids=False)
