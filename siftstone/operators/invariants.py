"""Rules that rows must keep, classes of errors, and what is done about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold; a rule that is null does not hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def context_rules(scores: str, least: float = 0.45) -> dict[str, Column]:
    """A context's scores are in [0, 1] and fall, and its mean decides the flag `meets` of column `mean_score`."""
    s = F.col(scores)
    falls = F.forall(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: F.coalesce(F.get(s, i - 1) >= F.get(s, i), F.lit(True)))
    return {"range": F.forall(s, lambda x: x.between(0, 1)), "order": falls, "flag": F.col("meets") == (F.col("mean_score") >= least)}


def response_rules(text: str, confidence: str, relevance: str, citations: str) -> dict[str, Column]:
    return {
        "length": F.length(text) <= 4000,
        "scores": F.col(confidence).between(0, 1) & F.col(relevance).between(0, 1),
        "citations": F.size(citations) >= 1,
        "quotes": F.forall(citations, lambda q: F.length(q).between(1, 200)),
    }


def query_rules(text: str, ts: str, key: str, now) -> dict[str, Column]:
    return {"text": F.length(F.trim(text)).between(1, 2000), "age": F.col(ts) >= F.lit(now) - F.expr("interval 7 days"), "key": F.contains(key, F.lit(":"))}


def accepted(confidence: Column, relevance: Column, least_confidence: float = 0.7, least_relevance: float = 0.6) -> tuple[Column, Column]:
    """(whether an answer may be shown, why not)."""
    low_c, low_r = confidence < least_confidence, relevance < least_relevance
    why = F.when(low_c & low_r, "confidence and relevance").when(low_c, "confidence").when(low_r, "relevance")
    return ~low_c & ~low_r, why


#: Fixed: marks of errors that do not pass by themselves, then of those that do; the first that fits tells why.
PERMANENT = [
    "authentication", "invalid_api_key", "invalid api key", "unauthorized", "401", "permission", "forbidden", "403", "invalid_request", "invalid request", "malformed", "schema", "unprocessable",
    "content_filter", "content filter", "content_policy", "content policy", "blocked", "safety", "recitation", "refusal", "not_found", "not found", "404", "canceled", "cancelled",
]
TRANSIENT = [
    "rate limit", "rate_limit", "ratelimit", "429", "too many requests", "overloaded", "529", "503", "500", "502", "service unavailable", "unavailable", "server_error", "server error", "api_error", "internal",
    "timeout", "timed out", "expired", "connection", "insufficient credits", "insufficient_credits", "insufficient_quota", "insufficient quota", "quota", "billing", "payment",
]


def error_reason(message: Column) -> Column:
    """The first mark that an error's text has, permanent ones before the others, or `unclassified`."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, PERMANENT + TRANSIENT)), lambda m: F.contains(low, m)), F.lit(0)), F.lit("unclassified"))


def error_class(message: Column) -> Column:
    return F.when(error_reason(message).isin(PERMANENT), "permanent").otherwise("transient")


def batch_results(requests: DataFrame, results: DataFrame, key: str, error: str) -> DataFrame:
    """(key, state) of every request: succeeded, retry or failed; one without a result is tried again."""
    got = results.select(F.col(key).alias("_k"), F.col(error).alias("_e"))
    state = F.when(F.col("_k").isNull(), "retry").when(F.col("_e").isNull(), "succeeded").when(error_class(F.col("_e")) == "permanent", "failed").otherwise("retry")
    return requests.join(got, F.col(key) == F.col("_k"), "left").select(*requests.columns, state.alias("state"))


def clamped_votes(votes: DataFrame, target: str, order: str, change: str) -> DataFrame:
    """(target, count): changes added in order, never below 0.

    The running floor is the least prefix sum so far, so the clamp is two windows and no fold.
    """
    w = Window.partitionBy(target).orderBy(order)
    sums = votes.withColumn("_s", F.sum(change).over(w))
    low = sums.withColumn("_low", F.least(F.lit(0), F.min("_s").over(w)))
    return low.groupBy(target).agg(F.max_by(F.col("_s") - F.col("_low"), order).alias("count"))


def conversation_rules(messages: str, ttl: str) -> dict[str, Column]:
    return {"messages": F.col(messages) <= 10, "ttl": F.col(ttl) > 0}


def conversation_expired(last: Column, ttl_seconds: Column, now) -> Column:
    return F.lit(now) > F.timestamp_micros(F.unix_micros(last) + ttl_seconds * 1_000_000)


def job_rules(started: str, completed: str, status: str, errors: str, tokens: str) -> dict[str, Column]:
    """A job ends no earlier than it begins, has an error if it failed, and counts no tokens below 0."""
    return {
        "completed": F.col(completed).isNull() | (F.col(completed) >= F.col(started)),
        "errors": (F.col(status) != "failed") | (F.size(errors) > 0),
        "tokens": F.col(tokens) >= 0,
    }


def complete(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, complete): whether all texts of a key are there and not blank."""
    return rows.groupBy(key).agg(F.bool_and(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").alias("complete"))
