"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sizes import small

#: Short truths that are broadcast to every text.
SHORT_TRUTHS = 10_000

#: Fixed: weights of ground truths by priority, and of the parts of an answer's score.
PRIORITY = {"critical": 10, "important": 5, "supporting": 3}
PARTS = {"answer_correctness": 0.50, "quote_faithfulness": 0.20, "quote_recall": 0.15, "quote_precision": 0.10, "context_recall": 0.05}
PASS = 80.0


def ranking_measures(truths: DataFrame, k_recall: int = 5, k_precision: int = 3) -> DataFrame:
    """From (query_id, rank or null), a row for each ground truth: average precision, recall, precision, reciprocal rank.

    Two ground truths may stand at one rank, so the average precision may pass 1.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last())
    df = truths.withColumn("_i", F.row_number().over(order))
    hit = F.col("rank").isNotNull()
    share = lambda x: F.round(x, 6)
    return df.groupBy("query_id").agg(
        share(F.coalesce(F.sum(F.when(hit, F.col("_i") / F.col("rank"))), F.lit(0.0)) / F.count("*")).alias("average_precision"),
        share(F.count_if(F.col("rank") <= k_recall) / F.count("*")).alias("recall_at_k"),
        share(F.count_if(hit) / F.count("*")).alias("recall"),
        share(F.count_if(F.col("rank") <= k_precision) / k_precision).alias("precision_at_k"),
        share(F.coalesce(1 / F.min("rank"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def measures_of_hits(hits: DataFrame, totals: DataFrame, k_recall: int = 5, k_precision: int = 3) -> DataFrame:
    """ranking_measures from the truths that were found, (query_id, rank), and how many there are, (query_id, truths): what was missed is no row."""
    order = Window.partitionBy("query_id").orderBy("rank")
    df = totals.join(hits.withColumn("_i", F.row_number().over(order)), "query_id", "left")
    n, share = F.first("truths"), lambda x: F.round(x, 6)
    return df.groupBy("query_id").agg(
        share(F.coalesce(F.sum(F.col("_i") / F.col("rank")), F.lit(0.0)) / n).alias("average_precision"),
        share(F.count_if(F.col("rank") <= k_recall) / n).alias("recall_at_k"),
        share(F.count("rank") / n).alias("recall"),
        share(F.count_if(F.col("rank") <= k_precision) / k_precision).alias("precision_at_k"),
        share(F.coalesce(1 / F.min("rank"), F.lit(0.0))).alias("reciprocal_rank"),
    )


def macro(measures: DataFrame) -> DataFrame:
    names = [x for x in measures.columns if x != "query_id"]
    return measures.agg(F.count("*").alias("queries"), *(F.round(F.avg(x), 6).alias(f"mean_{x}") for x in names), *(F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias(f"std_{x}") for x in names))


#: Words in a run that candidates are found by; shorter truths are looked for in every text.
RUN = 5


def _runs(words: str) -> Column:
    """Hashes of every RUN words in a row; an empty array for fewer."""
    last = F.size(words) - RUN + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, RUN)))).otherwise(F.array().cast("array<bigint>"))


def found_in(truths: DataFrame, texts: DataFrame, truth: str, text: str, truth_id: str | None = None, text_id: str | None = None) -> DataFrame:
    """Pairs of a ground truth and a text that contains it, both in their normal form; ids, by default the first columns, tell the rows of each side apart.

    A truth is looked for only in texts that have its anchor, the least hash of its runs of RUN words
    between its first and last word (which may stand inside other words of a text). Runs meet anchors by ids alone; the
    texts are joined with the pairs that are left. Truths that are too short for an anchor, if there are any, are compared
    with every text. Truths, anchors and pairs are broadcast behind a check of their size.
    """
    truth_id, text_id = truth_id or truths.columns[0], text_id or texts.columns[0]
    a = truths.withColumn("_truth", T.normal_for_matching(F.col(truth)))
    inner = F.split("_truth", " ")
    a = a.withColumn("_inner", F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))).withColumn("_anchor", F.array_min(_runs("_inner"))).drop("_inner")
    normal = T.normal_for_matching(F.col(text))
    words = texts.select(text_id, F.split(normal, " ").alias("_words"))
    anchors = a.where("_anchor is not null").select(truth_id, "_anchor")
    run = words.select(text_id, F.explode(_runs("_words")).alias("_run"))
    pairs = run.join(small(anchors), F.col("_run") == F.col("_anchor")).select(text_id, truth_id).distinct()
    near = texts.join(pairs, text_id).join(small(a.drop("_anchor")), truth_id)
    found = near.where(F.contains(normal, F.col("_truth")))
    short = a.where("_anchor is null").drop("_anchor")
    if short.limit(1).count():
        found = found.unionByName(texts.join(small(short, SHORT_TRUTHS), F.contains(normal, F.col("_truth"))))
    return found


def weight(priority: Column) -> Column:
    out = F.lit(PRIORITY["critical"])
    for name, value in PRIORITY.items():
        out = F.when(priority == name, value).otherwise(out)
    return out


def answer_score(parts: dict[str, Column], failed: Column) -> Column:
    """Weighted mean of the parts that are there, times 100; 0 for a failed answer."""
    total = sum((F.when(c.isNotNull(), F.lit(PARTS[k])).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(c * PARTS[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    return F.when(failed, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(value, total) * 100, F.lit(0.0)))


def status(score: Column, failed: Column) -> Column:
    return F.when(failed, "error").when(score >= PASS, "passed").when(score < 50, "failed").otherwise("partial")
