"""Fusion of two rankings, and what follows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, TEXT_WEIGHT, LOW, HIGH = 60, 0.5, 0.45, 1.0


def reciprocal_rank(vector: DataFrame, text: DataFrame, k: int, rrf_k: int = RRF_K, text_weight: float = TEXT_WEIGHT, near: bool = False) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, id, rank, ...) lists: the best k of each query.

    `relevance` stretches the kept scores to 0.45..1. A hit of the text list alone has a null similarity.
    With `near`, queries without any vector hit have no result.
    """
    v = vector.select("query_id", "id", F.col("rank").alias("vector_rank"), "similarity")
    x = text.select("query_id", "id", F.col("rank").alias("text_rank"), F.col("score").alias("text_score"))
    part = lambda w, rank: F.coalesce(w / (rrf_k + F.col(rank)), F.lit(0.0))
    both = v.join(x, ["query_id", "id"], "full").withColumn("rrf", F.round(part(1 - text_weight, "vector_rank") + part(text_weight, "text_rank"), 9))
    if near:
        both = both.withColumn("_near", F.min("vector_rank").over(Window.partitionBy("query_id"))).where("_near is not null").drop("_near")
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id")
    kept = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    own = Window.partitionBy("query_id")
    low, high = F.min("rrf").over(own), F.max("rrf").over(own)
    span = F.when(high > low, high - low).otherwise(1.0)
    return kept.withColumn("relevance", F.round(LOW + (F.col("rrf") - low) / span * (HIGH - LOW), 6))


def hybrid(vector: DataFrame, text: DataFrame, k: int, **options) -> DataFrame:
    """Fusion for queries that have a vector hit at all; the others have no result."""
    return reciprocal_rank(vector, text, k, near=True, **options)


def gated(hits: DataFrame, score: str, least: float) -> DataFrame:
    """All hits of the queries whose mean score is enough."""
    return hits.withColumn("_mean", F.avg(score).over(Window.partitionBy("query_id"))).where(F.col("_mean") >= least).drop("_mean")


def contexts(hits: DataFrame, score: str, least: float) -> DataFrame:
    """One row a query: its ids by rank, how many, mean score, and whether that is enough."""
    mean = F.round(F.avg(score), 6)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return hits.groupBy("query_id").agg(ids.alias("ids"), F.count("*").alias("total"), mean.alias("mean_score"), (mean >= least).alias("meets"))


def reranked(hits: DataFrame, score: str, ordinal: str, k: int = 20) -> DataFrame:
    """First occurrence of each id, then the best k by score; ties keep their order."""
    first = Window.partitionBy("query_id", "id").orderBy(ordinal)
    best = Window.partitionBy("query_id").orderBy(F.desc(score), ordinal)
    once = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
