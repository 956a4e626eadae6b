"""Cost of model calls by a price book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_model
from .sizes import small

#: Fixed: multipliers, discounts and the rate of unknown models.
SEPARATE_READ, SEPARATE_WRITE = 0.1, 1.25
BATCH_DISCOUNT, DEFAULT_DISCOUNT = {"x": 0.2}, 0.5
FALLBACK = {"prompt": 0.002, "completion": 0.002, "ratio": 1.0}


def discount(backend: Column) -> Column:
    name = F.split_part(F.coalesce(backend, F.lit("")), F.lit("::"), F.lit(1))
    out = F.lit(DEFAULT_DISCOUNT)
    for k, v in BATCH_DISCOUNT.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def priced(calls: DataFrame, book: DataFrame, model: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds prompt_rate, completion_rate, cache_ratio and separate_cache; a model's #effort plays no part.

    An alias is priced as the model it stands for, also where the book has a price of its own; aliases are not followed twice.
    The book is broadcast behind a check of its size, so calls stay where they are: all of one model would meet in one task.
    """
    name = base_model(F.col(model))
    if aliases:
        name = F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[name], name)
    rates = book.select(F.col("model").alias("_m"), F.col("prompt").alias("_p"), F.col("completion").alias("_c"), F.col("ratio").alias("_r"), F.col("separate").alias("_s"))
    both = calls.join(small(rates), name == F.col("_m"), "left")
    return both.select(*calls.columns, F.coalesce("_p", F.lit(FALLBACK["prompt"])).alias("prompt_rate"), F.coalesce("_c", F.lit(FALLBACK["completion"])).alias("completion_rate"), F.coalesce("_r", F.lit(FALLBACK["ratio"])).alias("cache_ratio"), F.coalesce("_s", F.lit(False)).alias("separate_cache"))


def breakdown(calls: DataFrame, prompt: str, completion: str, read: str, written: str, batch: Column, backend: Column) -> DataFrame:
    """Adds prompt_cost, completion_cost, read_cost, write_cost, total_cost, cache_savings, batch_savings to priced calls.

    With a separate cache, reads and writes come on top of the prompt; else cached tokens are a part of it. A batch
    discount takes its share of every cost, after the cache's savings are known.
    """
    p, sep = F.col("prompt_rate"), F.col("separate_cache")
    k = lambda c: c / 1000
    subset = F.least(read, prompt)
    prompt_cost = F.when(sep, k(F.col(prompt)) * p).otherwise(k(F.col(prompt) - subset) * p)
    read_cost = F.when(sep, k(F.col(read)) * p * SEPARATE_READ).otherwise(k(subset) * p * F.col("cache_ratio"))
    write_cost = F.when(sep, k(F.col(written)) * p * SEPARATE_WRITE).otherwise(0.0)
    savings = F.when(sep, k(F.col(read)) * p * (1 - SEPARATE_READ) - k(F.col(written)) * p * (SEPARATE_WRITE - 1)).otherwise(k(subset) * p * (1 - F.col("cache_ratio")))
    completion_cost = k(F.col(completion)) * F.col("completion_rate")
    df = calls.select("*", prompt_cost.alias("_a"), completion_cost.alias("_b"), read_cost.alias("_c"), write_cost.alias("_d"), savings.alias("cache_savings"), F.when(batch, discount(backend)).otherwise(0.0).alias("_x"))
    total = F.col("_a") + F.col("_b") + F.col("_c") + F.col("_d")
    left = 1 - F.col("_x")
    names = {"prompt_cost": "_a", "completion_cost": "_b", "read_cost": "_c", "write_cost": "_d"}
    return df.select(*calls.columns, *((F.col(v) * left).alias(n) for n, v in names.items()), (total * left).alias("total_cost"), "cache_savings", (total * F.col("_x")).alias("batch_savings"))


def hop_tokens(prompt: Column, completion: Column, total: Column) -> tuple[Column, Column]:
    """Prompt and completion tokens of a hop; 70 / 30 of the total, cut to whole numbers, if neither is known."""
    none = (prompt == 0) & (completion == 0)
    return F.when(none, F.floor(total * 0.7)).otherwise(prompt), F.when(none, F.floor(total * 0.3)).otherwise(completion)


def hop_costs(hops: DataFrame, book: DataFrame, prompt: str, completion: str, total: str, read: str, written: str, served: str, asked: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds the costs of hops' judge calls, by the model that served them, or the asked one where that is null or blank; never a batch."""
    a, b = hop_tokens(F.col(prompt), F.col(completion), F.col(total))
    calls = hops.select("*", a.alias("_prompt"), b.alias("_completion"), F.coalesce(F.nullif(F.col(served), F.lit("")), F.col(asked)).alias("_priced"))
    done = breakdown(priced(calls, book, "_priced", aliases), "_prompt", "_completion", read, written, F.lit(False), F.lit(None).cast("string"))
    return done.select(*hops.columns, "prompt_cost", "completion_cost", "read_cost", "write_cost", "total_cost", "cache_savings")
