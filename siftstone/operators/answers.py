"""Structured answers: prompts before them, their parts, and measures and messages after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import shapes
from .metrics import weight

CUT, SHOWN = 500, 120
MERGE = " [...] "
ANSWER = "smalltalk boolean, short_answer string, persona_short_answer string, quotes string, explanation string, persona_afterword string"

#: Fixed: what an error's text has, and what a user is told; the first that fits.
TOLD = [
    ("credit", ["credit balance", "insufficient funds", "insufficient quota", "quota"]),
    ("key", ["invalid api key", "authentication", "unauthorized"]),
    ("rate", ["rate limit", "too many requests"]),
    ("content", ["filter", "policy", "safety"]),
    ("overload", ["overload", "unavailable", "temporarily down", "503"]),
]
#: Fixed: dollars a million tokens, dimensions; an unknown model counts as the first.
EMBEDDING = {"text-embedding-3-small": (0.020, 1536), "text-embedding-3-large": (0.130, 3072), "text-embedding-ada-002": (0.100, 1536)}


# -- prompts --------------------------------------------------------------------------------


def context_text(ids: Column, texts: Column) -> Column:
    """The chunks of a prompt, each under the last eight characters of its id; the two lists must be as long."""
    parts = F.zip_with(ids, texts, lambda i, t: F.concat(F.lit("[CHUNK_"), F.right(i, F.lit(8)), F.lit("]:\n"), t))
    return F.when(F.size(ids) == F.size(texts), F.array_join(parts, "\n\n")).otherwise(F.raise_error("as many ids as chunks are needed"))


def hop_entry(number: Column, text: Column, summary: Column) -> Column:
    """A numbered chunk for the judge: of long texts the beginning and the ### headers of the rest; with a summary the first line and it."""
    rest = F.filter(F.transform(F.split(F.substring(text, CUT + 1, 1_000_000_000), "\n"), T.trim_all), lambda x: F.startswith(x, F.lit("###")))
    short = F.concat(F.substring(text, 1, CUT), F.lit("..."), F.when(F.size(rest) > 0, F.concat(F.lit("\n"), F.array_join(rest, "\n"))).otherwise(""))
    shown = F.when(F.length(text) > CUT, short).otherwise(text)
    body = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.split_part(shown, F.lit("\n"), F.lit(1)), F.lit("\n"), summary)).otherwise(shown)
    return F.concat(number.cast("string"), F.lit(". "), body, F.lit("\n"))


def titles(text: Column) -> Column:
    """Titles between commas, trimmed and without quotes around them."""
    return F.transform(F.filter(F.split(text, ","), lambda x: T.trim_all(x) != ""), lambda x: F.btrim(T.trim_all(x), F.lit("'\"")))


# -- answers --------------------------------------------------------------------------------


def parsed(rows: DataFrame, json: str) -> DataFrame:
    """Adds the fields of an answer, `faults` and `valid`: whether it has the shape of an answer, see shapes.shaped."""
    df = shapes.shaped(rows.withColumn("_json", F.col(json)), "_json").withColumn("_a", F.try_parse_json("_json"))
    names = [x.split(" ") for x in ANSWER.split(", ")]
    fields = [F.try_variant_get("_a", f"$.{x}", kind).alias(x) for x, kind in names if x != "quotes"]
    quote = lambda q: F.struct(*(F.try_variant_get(q, f"$.{k}", "string").alias(k) for k in ("quote_title", "quote_text")), F.coalesce(F.try_variant_get(q, "$.chunk_id", "string"), F.lit("")).alias("chunk_id"))
    return df.select(*rows.columns, *fields, F.transform("quotes", quote).alias("quotes"), "faults", (F.size("faults") == 0).alias("valid"))


def merged_quotes(answers: DataFrame, key: str) -> DataFrame:
    """(key, place, quote_title, quote_text, chunk_id): quotes of one chunk, or of one title where there is no chunk, joined in order."""
    q = answers.select(key, F.posexplode("quotes").alias("at", "q")).select(key, "at", "q.*")
    of = F.coalesce(F.nullif("chunk_id", F.lit("")), "quote_title")
    order = F.array_sort(F.collect_list(F.struct("at", "quote_text")))
    one = q.groupBy(key, of.alias("_of")).agg(F.min("at").alias("at"), F.min_by("quote_title", "at").alias("quote_title"), F.array_join(F.transform(order, lambda x: x["quote_text"]), MERGE).alias("quote_text"), F.min_by("chunk_id", "at").alias("chunk_id"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at"))).drop("at", "_of")


def markdown(short: Column, persona: Column, quotes: Column, explanation: Column, afterword: Column) -> Column:
    """An answer as markdown: bold answer, quotes as blocks, explanation and afterword."""
    shown = F.transform(quotes, lambda q: F.concat(F.lit("> **"), q["quote_title"], F.lit("**\n> "), q["quote_text"]))
    blocks = F.flatten(F.transform(shown, lambda x: F.array(x, F.lit(""))))
    head = F.array(F.concat(F.lit("**"), short, F.lit("** "), persona), F.lit(""))
    return F.array_join(F.concat(head, blocks, F.array(F.lit("## Explanation"), explanation, F.lit(""), afterword)), "\n")


def checked(smalltalk: Column, quotes: Column) -> Column:
    """Whether an answer's quotes are to be checked at all."""
    return ~F.coalesce(smalltalk, F.lit(False)) & (F.size(quotes) > 0)


def told(error: Column) -> Column:
    """The kind of message that a user gets for an error."""
    low = F.lower(F.coalesce(error, F.lit("")))
    out = F.lit("generic")
    for kind, marks in reversed(TOLD):
        fits = F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))
        out = F.when(fits & F.contains(low, F.lit("content")) if kind == "content" else fits, kind).otherwise(out)
    return out


def hits_of(text: Column, patterns: list[str]) -> Column:
    """The patterns that a text has, in any case."""
    return F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower(text), F.lower(p)))


# -- measures -------------------------------------------------------------------------------


def ranked_truths(truths: DataFrame, chunks: DataFrame, key: str, truth: str, header: str, text: str, rank: str) -> DataFrame:
    """Truths with `rank`: of the first chunk of their key whose header has them, else of the first whose text has them."""
    own = truths.withColumn("_t", T.normal_for_matching(F.col(truth)))
    of = chunks.select(key, F.col(rank).alias("_r"), T.normal_for_matching(F.col(header)).alias("_h"), T.normal_for_matching(F.col(text)).alias("_x"))
    first = lambda name: F.min(F.when(F.contains(name, "_t"), F.col("_r")))
    return own.join(of, key, "left").groupBy(*truths.columns).agg(F.coalesce(first("_h"), first("_x")).alias("rank"))


def quote_measures(truths: DataFrame, quotes: DataFrame, key: str, truth: str, priority: str, title: str, text: str) -> DataFrame:
    """(key, quote_recall, quote_precision): the weight of the truths that some quote has, and the share of quotes that have some truth."""
    t = truths.select(key, F.monotonically_increasing_id().alias("_i"), T.normal_for_matching(F.col(truth)).alias("_t"), weight(F.col(priority)).alias("_w"))
    q = quotes.select(key, F.monotonically_increasing_id().alias("_q"), T.normal_for_matching(F.concat_ws(" ", title, text)).alias("_x"))
    hit = F.coalesce(F.contains("_x", "_t"), F.lit(False))
    of_truths = t.join(q, key, "left").groupBy(key, "_i", "_w").agg(F.max(hit).alias("hit")).groupBy(key).agg(F.round(F.sum(F.when(F.col("hit"), F.col("_w")).otherwise(0)) / F.sum("_w"), 6).alias("quote_recall"))
    of_quotes = q.join(t, key, "left").groupBy(key, "_q").agg(F.max(hit).alias("hit")).groupBy(key).agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("quote_precision"))
    return of_truths.join(of_quotes, key, "left").select(key, "quote_recall", F.coalesce("quote_precision", F.lit(0.0)).alias("quote_precision"))


def missing_truths(truths: DataFrame, texts: DataFrame, key: str, truth: str, text: str) -> DataFrame:
    """Truths that no text of their key has and that have no text of it either, with `shown`, cut at SHOWN characters."""
    t = truths.withColumn("_t", T.normal_for_matching(F.col(truth)))
    x = texts.select(F.col(key).alias("_k"), T.normal_for_matching(F.col(text)).alias("_x"))
    left = t.join(x, (F.col(key) == F.col("_k")) & (F.contains("_x", "_t") | F.contains("_t", "_x")), "left_anti")
    return left.select(*truths.columns, F.when(F.length(truth) > SHOWN, F.concat(F.substring(truth, 1, SHOWN), F.lit("..."))).otherwise(F.col(truth)).alias("shown"))


def judged(scores: DataFrame, answers: DataFrame, test: str, key: str, score: str, priority: str, order: str | None = None) -> DataFrame:
    """(test, answer_correctness): the judge's scores, weighted by the priority of the answer with that key in any case; other keys are left out.

    Of a test's answers whose keys differ by case only, the last by `order` counts, by default the greatest key.
    """
    known = answers.groupBy(F.col(test).alias("_test"), F.lower(key).alias("_key")).agg(F.max_by(weight(F.col(priority)), F.struct(order or key, priority)).alias("_w"))
    hit = scores.join(known, (F.col(test) == F.col("_test")) & (F.lower(key) == F.col("_key")), "left")
    total = F.sum("_w")
    return hit.groupBy(test).agg(F.round(F.coalesce(F.try_divide(F.sum(F.col(score) * F.col("_w")), total), F.lit(0.0)), 6).alias("answer_correctness"))


def doubtful(rows: DataFrame, score: str) -> DataFrame:
    """Answers whose quotes were not all found, the worst first."""
    return rows.where(F.col(score) < 1.0).orderBy(score)


def embedding_cost(tokens: Column, model: Column) -> Column:
    rate = F.lit(EMBEDDING["text-embedding-3-small"][0])
    for name, (price, _) in EMBEDDING.items():
        rate = F.when(model == name, price).otherwise(rate)
    return tokens * rate / 1_000_000


def dimensions(model: Column) -> Column:
    out = F.lit(EMBEDDING["text-embedding-3-small"][1])
    for name, (_, size) in EMBEDDING.items():
        out = F.when(model == name, size).otherwise(out)
    return out


# -- joins around an answer -------------------------------------------------------------------


def with_hop(chunks: DataFrame, hops: DataFrame, chunk: str, hop: str) -> DataFrame:
    """Chunks with the hop that brought them, 0 for the first retrieval."""
    return chunks.join(hops.select(chunk, hop), chunk, "left").withColumn(hop, F.coalesce(hop, F.lit(0)))


def kept_hops(hops: DataFrame, kept: DataFrame, chunk: str) -> DataFrame:
    """The hop map of the chunks that were kept."""
    return hops.join(kept.select(chunk), chunk, "left_semi")


def with_summary(chunks: DataFrame, summaries: DataFrame, key: str, ordinal: str, number: str, summary: str, order: str) -> DataFrame:
    """Chunks with the summary of their 1-based ordinal in the key; of several the last counts."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    last = summaries.groupBy(key, F.col(number).alias("_n")).agg(F.max_by(summary, order).alias("summary"))
    return chunks.withColumn("_n", at).join(last, [key, "_n"], "left").drop("_n")


def by_prefix(short: DataFrame, prefix: str, full: DataFrame, full_id: str, order: str, size: int) -> DataFrame:
    """Rows with `found`: the first full id that begins with their prefix of `size` characters; without one they go."""
    first = full.groupBy(F.left(full_id, F.lit(size)).alias("_p")).agg(F.min_by(full_id, order).alias("found"))
    return short.join(first, F.col(prefix) == F.col("_p")).drop("_p")


def freshness(listing: DataFrame, files: DataFrame, key: str, listed: str, have: str, force: bool = False) -> DataFrame:
    """Listed items with `why`: new, forced, undated or updated ones are to be fetched, current ones not."""
    df = listing.join(files.select(key, have), key, "left")
    why = F.when(F.col(have).isNull(), "new").when(F.lit(force), "forced").when(F.col(listed).isNull(), "undated").when(F.col(listed) > F.col(have), "updated").otherwise("current")
    return df.withColumn("why", why)


def added(old: DataFrame, new: DataFrame, word: str) -> DataFrame:
    """The union of two word sets, with whether the second added the word."""
    known = old.select(word).distinct().withColumn("_old", F.lit(True))
    return known.join(new.select(word).distinct(), word, "full").select(word, F.col("_old").isNull().alias("added"))
