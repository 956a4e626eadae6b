"""Small rules over single records: downloads, citations, and the parts of a query's cost and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .answers import embedding_cost

#: Fixed: fields that a download's beginning has, how much of it is looked at, and what a citation has where nothing is known.
DOWNLOAD_FIELDS, BEGINNING = ["source", "last_update_date", "document_type", "section"], 500
NO_SOURCE, NO_HEADER, NO_KIND, NO_DAY = "Unknown", "General", "core-rules", "2024-01-15"
SMALLTALK = "[SMALLTALK]"


def valid_url(url: Column) -> Column:
    return F.coalesce(F.startswith(url, F.lit("https://")), F.lit(False))


def valid_version(version: Column) -> Column:
    """Two numbers around a dot, or a word with a year and a month."""
    return F.coalesce(version.rlike(r"^(?U:\d)+\.(?U:\d)+\n?\z") | version.rlike(r"^[A-Za-z]+-?(?U:\d){4}-(?U:\d){2}\n?\z"), F.lit(False))


def with_front(markdown: Column, team: Column, day: Column) -> Column:
    """A downloaded text with its frontmatter in front."""
    return F.concat(F.lit('---\nsource: "WC downloads"\nlast_update_date: '), F.date_format(day, "yyyy-MM-dd"), F.lit("\ndocument_type: team-rules\nsection: "), team, F.lit("\n---\n\n"), markdown)


def download_warnings(markdown: Column, team: Column) -> Column:
    """What a finished download lacks: "frontmatter", the names of fields, "team" (a header with its name), "headers"."""
    start = F.substring(markdown, 1, BEGINNING)
    named = F.contains(F.upper(markdown), F.concat(F.lit("## "), F.upper(F.replace(team, F.lit("_"), F.lit(" ")))))
    fields = [F.when(~F.contains(start, F.lit(f"{x}:")), F.lit(x)) for x in DOWNLOAD_FIELDS]
    return F.array_compact(F.array(F.when(~F.startswith(markdown, F.lit("---")), F.lit("frontmatter")), *fields, F.when(~named, F.lit("team")), F.when(~F.contains(markdown, F.lit("## ")), F.lit("headers"))))


def listing_day(text: Column, seconds: Column) -> Column:
    """The day of a listing's entry: of its text as day/month/year, else of its time stamp if that is over 0."""
    real = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "d/M/yyyy"))
    return F.coalesce(real, F.when(seconds > 0, F.to_date(F.timestamp_seconds(seconds))))


def citations(chunks: DataFrame, source: str, header: str, text: str, kind: str, day: str) -> DataFrame:
    """Chunks with what a citation says of them."""
    known = lambda x, default: F.coalesce(F.col(x), F.lit(default))
    section = F.when(F.coalesce(header, F.lit("")) == "", NO_HEADER).otherwise(F.col(header))
    return chunks.select(*chunks.columns, F.struct(known(source, NO_SOURCE).alias("document"), section.alias("section"), F.col(text).alias("quote"), known(kind, NO_KIND).alias("kind"), F.to_date(known(day, NO_DAY)).alias("updated")).alias("citation"))


def smalltalk(flag: Column, text: Column) -> tuple[Column, Column]:
    """(whether an answer is smalltalk, what is shown of it); such an answer has no citations."""
    flag, tagged = F.coalesce(flag, F.lit(False)), F.startswith(text, F.lit(SMALLTALK))
    return flag | tagged, F.when(~flag & tagged, T.trim_all(F.replace(text, F.lit(SMALLTALK), F.lit("")))).otherwise(text)


def query_costs(queries: DataFrame, hops: DataFrame, key: str, tokens: str, model: str, main: str, hop_tokens: str, hop_cost: str) -> DataFrame:
    """(key, initial_embedding, hop_embedding, hop_evaluation, main_llm, total) of queries and their hops; a hop that asks for nothing has null tokens."""
    per = hops.groupBy(key).agg(F.sum(F.coalesce(hop_tokens, F.lit(0))).alias("_t"), F.sum(hop_cost).alias("hop_evaluation"))
    df = queries.join(per, key, "left")
    df = df.select(key, embedding_cost(F.col(tokens), F.col(model)).alias("initial_embedding"), embedding_cost(F.coalesce("_t", F.lit(0)), F.col(model)).alias("hop_embedding"), F.coalesce("hop_evaluation", F.lit(0.0)).alias("hop_evaluation"), F.col(main).alias("main_llm"))
    return df.withColumn("total", F.col("initial_embedding") + F.col("hop_embedding") + F.col("hop_evaluation") + F.col("main_llm"))


def latency_parts(retrieval: Column, hop_seconds: Column, main: Column, total: Column) -> Column:
    """retrieval (without hops), hops, main and total milliseconds; the total as measured, else the sum."""
    hops = F.floor(F.coalesce(hop_seconds, F.lit(0.0)) * 1000)
    return F.struct((retrieval - hops).alias("retrieval"), hops.alias("hops"), main.alias("main"), F.coalesce(total, retrieval + main).alias("total"))
