"""Totals of batches of calls, and the written summary of what a query has taken and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import embedding_cost

#: Fixed: the width of a summary's rule.
WIDTH = 60


def batch_totals(costs: DataFrame, *keys: str) -> DataFrame:
    """Sums of total_cost, cache_savings and batch_savings of broken-down calls, and the savings' shares of the full price in percent.

    Without keys there is one row, zeros if there are no calls; null costs are none.
    """
    parts = {x: F.coalesce(F.sum(x), F.lit(0.0)) for x in ("total_cost", "cache_savings", "batch_savings")}
    df = costs.groupBy(*keys).agg(F.count("*").alias("calls"), *(v.alias(k) for k, v in parts.items()))
    full = F.col("total_cost") + F.col("cache_savings") + F.col("batch_savings")
    share = lambda x: F.when(full > 0, F.col(x) / full * 100).otherwise(0.0)
    return df.select("*", share("cache_savings").alias("cache_share"), share("batch_savings").alias("batch_share"))


def _told(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *(v.cast("double") for v in values))


def _if(condition: Column, *lines: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(*lines)).otherwise(F.array().cast("array<string>"))


def time_lines(total: Column, initial: Column, hops: Column, main: Column) -> Column:
    """Lines on where the seconds of a query went; hops is a list of (retrieval_s, evaluation_s), main null without an answer."""
    head = F.array(_told("Total time: %.2fs", total), _told("  RAG retrieval: %.2fs", total - F.coalesce(main, F.lit(0.0))), _told("    Initial retrieval: %.2fs", initial))
    line = lambda h, i: F.concat(F.lit("    Hop "), (i + 1).cast("string"), _told(": %.2fs (retrieval: %.2fs, evaluation: %.2fs)", h["retrieval_s"] + h["evaluation_s"], h["retrieval_s"], h["evaluation_s"]))
    return F.concat(head, F.transform(hops, line), _if(main.isNotNull(), _told("  LLM generation: %.2fs", main)))


def cost_lines(initial: Column, asked_tokens: Column, embedding_model: Column, hop_embedding: Column, hop_evaluation: Column, hops: Column, judge: Column, main: Column, model: Column, prompt: Column, completion: Column, saved: Column) -> Column:
    """Lines on what a query has cost; hops is a list of (tokens, cost), tokens null where a hop asks for nothing.

    An initial embedding that cost nothing is priced by the tokens asked, if there are any. Savings may be negative;
    their share is of what the answer would have cost without them.
    """
    initial = F.when((initial == 0) & (asked_tokens > 0), embedding_cost(asked_tokens, embedding_model)).otherwise(initial)
    embedding = initial + hop_embedding
    rag = embedding + hop_evaluation
    some = F.size(hops) > 0
    head = F.array(_told("Total cost: $%.6f", rag + main), _told("  RAG costs: $%.6f", rag), _told("    Embeddings: $%.6f", embedding), _told("      Initial query: $%.6f", initial))
    number = lambda i: (i + 1).cast("string")
    asked = F.array_compact(F.transform(hops, lambda h, i: F.when(h["tokens"].isNotNull(), F.concat(F.lit("        Hop "), number(i), _told(": $%.6f", embedding_cost(h["tokens"], embedding_model))))))
    judged = F.transform(hops, lambda h, i: F.concat(F.lit("      Hop "), number(i), F.lit(" LLM ("), judge, F.lit(")"), _told(": $%.6f", h["cost"])))
    none = F.array().cast("array<string>")
    by_hop = F.when(some & (hop_embedding > 0), F.concat(F.array(_told("      Hop queries: $%.6f", hop_embedding)), asked)).otherwise(none)
    by_judge = F.when(some & (hop_evaluation > 0), F.concat(F.array(_told("    Hop evaluations: $%.6f", hop_evaluation)), judged)).otherwise(none)
    share = F.when(main + F.abs(saved) > 0, F.abs(saved) / (main + F.abs(saved)) * 100).otherwise(0.0)
    savings = F.concat(F.lit("    Cache savings:     "), F.when(saved < 0, "-").otherwise(""), _told("$%.6f (%.1f%%)", F.abs(saved), F.bround(share, 1)))
    tokens = _if(prompt > 0, F.concat(F.lit("    Prompt tokens: "), F.format_number(prompt, 0)), F.concat(F.lit("    Completion tokens: "), F.format_number(completion, 0)))
    answer = F.concat(F.array(_told("  LLM generation: $%.6f", main)), _if(model != "", F.concat(F.lit("    Model: "), model)), tokens, _if(saved != 0, savings))
    return F.concat(head, by_hop, by_judge, F.when(main > 0, answer).otherwise(none))


def summary(times: Column, costs: Column, answered: Column) -> Column:
    """The written summary of a query's lines on time and cost."""
    rule = F.lit("=" * WIDTH)
    title = F.when(answered, "SUMMARY").otherwise("SUMMARY (RAG-only mode)")
    return F.array_join(F.concat(F.array(rule, title, rule, F.lit("")), times, F.array(F.lit("")), costs, F.array(rule, F.lit(""))), "\n")
