"""Evaluation across hops, runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits_by_hop(found: DataFrame, query: str, truth: str, hop: str) -> DataFrame:
    """(hop, truths, gained): distinct ground truths that are found up to each hop, and how many of them are new."""
    first = found.groupBy(query, truth).agg(F.min(hop).alias("hop"))
    per = first.groupBy("hop").agg(F.count("*").alias("gained"))
    return per.select("hop", F.sum("gained").over(Window.orderBy("hop")).alias("truths"), "gained")


def rank_summary(found: DataFrame, rank: str) -> DataFrame:
    """Largest and mean rank of what was found; ranks of 0 and less count as not found."""
    r = F.when(F.col(rank) > 0, F.col(rank))
    return found.agg(F.max(r).alias("most"), F.round(F.avg(r), 6).alias("mean"), F.count(r).alias("found"), (F.count("*") - F.count(r)).alias("missing"))


def pass_rates(runs: DataFrame, test: str, passed: Column) -> DataFrame:
    return runs.groupBy(test).agg(F.count("*").alias("runs"), F.round(F.avg(passed.cast("int")), 6).alias("rate")).orderBy(test)


def missing_counts(missing: DataFrame, chunk: str) -> DataFrame:
    return missing.groupBy(chunk).agg(F.count("*").alias("n")).orderBy(F.desc("n"), chunk)


def best_configuration(results: DataFrame, measure: str, ordinal: str) -> DataFrame:
    """The row of the largest measure; of equal ones the first."""
    return results.orderBy(F.desc(measure), ordinal).limit(1)


def configuration_key(parts: dict[str, tuple[str, str]]) -> Column:
    """A key such as mc15_mr0.45 from (format, column) by short name."""
    return F.concat_ws("_", *(F.format_string(f"{name}{form}", F.col(column)) for name, (form, column) in parts.items()))


def confidence(logprobs: Column, default: float = 0.7) -> Column:
    """The mean probability of a response's tokens, or the default where there are none."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda acc, x: acc + F.exp(x))
    return F.when(F.size(F.coalesce(logprobs, F.array().cast("array<double>"))) > 0, total / F.size(logprobs)).otherwise(default)


#: Fixed: the confidence that a safety rating stands for, and that of an unknown one.
SAFETY, SAFETY_DEFAULT = {"NEGLIGIBLE": 0.9, "LOW": 0.8, "MEDIUM": 0.7, "HIGH": 0.5}, 0.7


def safety_confidence(ratings: Column) -> Column:
    """The mean confidence of a list of safety ratings; that of an unknown rating where there are none."""
    known = F.create_map(*(F.lit(x) for pair in SAFETY.items() for x in pair))
    total = F.aggregate(ratings, F.lit(0.0), lambda acc, x: acc + F.coalesce(known[x], F.lit(SAFETY_DEFAULT)))
    return F.when(F.size(F.coalesce(ratings, F.array().cast("array<string>"))) > 0, total / F.size(ratings)).otherwise(SAFETY_DEFAULT)


def token_summary(rows: DataFrame, keys: list[str], tokens: str, cost: str) -> DataFrame:
    """Totals and means of tokens and cost by the keys, such as operation and provider."""
    return rows.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum(tokens).alias("total_tokens"), F.round(F.sum(cost), 4).alias("total_cost"), F.round(F.avg(tokens), 6).alias("mean_tokens"), F.round(F.avg(cost), 6).alias("mean_cost"))


def confidence_summary(rows: DataFrame, confidence: str, relevance: str, passed: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.round(F.avg(relevance), 6).alias("mean_relevance"), F.round(F.avg(passed.cast("int")), 6).alias("pass_rate"))


def error_counts(rows: DataFrame, key: str, error: Column, recovered: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.count_if(error & recovered).alias("recovered"))


#: Measures of a result: those with mean and deviation, and those with a mean alone.
SPREAD = ["score", "seconds", "cost", "gross_cost", "quote_recall", "quote_precision", "quote_faithfulness", "explanation_faithfulness", "answer_correctness"]
MEANS = ["multi_hop", "judge", "embedding", "batch_savings", "total_cost"]


def summaries(results: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """All measures of results by each of the keys, in one aggregation: (*keys, results, ...), where the keys of other groupings are null.

    Means and population deviations are over the values that are there; a deviation of fewer than two is 0. The gross cost is that
    before the savings of caches, whose share of it is cache_savings_pct; infrastructure is what hops, judge and embeddings cost.
    """
    df = results.withColumn("gross_cost", F.col("cost") + F.col("cache_savings"))
    out = [F.count("*").alias("results")]
    for x in SPREAD:
        out += [F.round(F.avg(x), digits).alias(f"avg_{x}"), F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), digits).alias(f"std_dev_{x}")]
    out += [F.round(F.avg(x), digits).alias(f"avg_{x}") for x in MEANS]
    out.append(F.round(F.coalesce(F.try_divide(F.avg("cache_savings"), F.avg("gross_cost")) * 100, F.lit(0.0)), digits).alias("avg_cache_savings_pct"))
    out.append(F.round(F.avg("multi_hop") + F.avg("judge") + F.avg("embedding"), digits).alias("avg_infrastructure"))
    return df.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(*out)
