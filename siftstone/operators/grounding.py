"""Quotes against the texts they should come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import ratio, windows
from ..functions.places import spans


def grounded(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, key: str, text_id: str, text: str, least: float = 0.85) -> DataFrame:
    """(quote_id, part, score, source, valid): parts around ' [...] ', each with its best text among those of the quote's key.

    A part that a text contains in normal form scores 1 and never meets the ratio; others take the best window of
    the text as it stands, each window brought into normal form. An empty quote counts as valid.
    """
    parts = quotes.select(quote_id, key, F.posexplode(F.split(quote, r"\[\.\.\.\]")).alias("part", "_p")).withColumn("_p", T.normal_quote(F.col("_p")))
    own = texts.select(key, F.col(text_id).alias("source"), F.col(text).alias("_raw"), T.normal_quote(F.col(text)).alias("_t"))
    both = parts.join(own, key, "left")
    exact = both.withColumn("_hit", F.contains("_t", "_p"))
    sure = exact.where("_hit").select(quote_id, "part", "source", F.lit(1.0).alias("score"))
    done = sure.select(quote_id, "part").distinct()
    rest = exact.join(done, [quote_id, "part"], "left_anti").select(quote_id, "part", "source", "_p", F.explode_outer(windows(F.col("_raw"), F.length("_p"))).alias("_w"))
    each = rest.select(quote_id, "part", "source", (ratio(F.col("_p"), T.normal_quote(F.col("_w"))) / 100).alias("score"))
    rest = each.groupBy(quote_id, "part", "source").agg(F.max("score").alias("score"))
    order = Window.partitionBy(quote_id, "part").orderBy(F.desc_nulls_last("score"), "source")
    best = sure.union(rest).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    score = F.round(F.coalesce("score", F.lit(0.0)), 6)
    return best.select(quote_id, "part", "source", score.alias("score"), (score >= least).alias("valid"))


def located(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, key: str, text_id: str, text: str) -> DataFrame:
    """(quote_id, part, source, start, end, shown): parts of quotes as grounded() cuts them, with their place in each text of their key that has them.

    Whether a text has a part is asked in normal form by Spark; only pairs that fit go on to the map of places.
    """
    parts = quotes.select(quote_id, key, F.posexplode(F.split(quote, r"\[\.\.\.\]")).alias("part", "_p")).withColumn("_p", T.normal_quote(F.col("_p"))).where("_p <> ''")
    own = texts.select(key, F.col(text_id).alias("source"), F.col(text).alias("_raw"))
    both = parts.join(own, key).where(F.contains(T.normal_quote(F.col("_raw")), F.col("_p")))
    return both.withColumn("_s", spans(F.col("_p"), F.col("_raw"))).select(quote_id, "part", "source", "_s.start", "_s.end", "_s.shown")


def faithfulness(parts: DataFrame, quote_id: str, key: str, least: float = 0.98) -> DataFrame:
    """(key, quotes, quote_faithfulness) from grounded(): the share of a key's quotes all parts of which score enough."""
    whole = parts.groupBy(key, quote_id).agg(F.min("score").alias("score"))
    return whole.groupBy(key).agg(F.count("*").alias("quotes"), F.round(F.avg((F.col("score") >= least).cast("int")), 6).alias("quote_faithfulness"))
