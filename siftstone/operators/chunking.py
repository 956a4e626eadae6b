"""Markdown documents: frontmatter, header chunks, identifiers and statistics.

Lines are cut, numbered and gathered inside arrays of their own document, so chunking needs no
shuffle; a document is one row before and `chunks` rows after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed: the kinds of documents that are accepted.
KINDS = ["core-rules", "faq", "team-rules", "ops"]
FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
DAY = r"^\d{4}-\d{2}-\d{2}$"


def frontmatter(text: Column) -> Column:
    """The block between the marks at the very start, or null."""
    return F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 1))


def front_value(front: Column, key: str) -> Column:
    return F.regexp_extract(front, rf"(?m)^{key}: *(.*)$", 1)


WHOLE_FRONT = r"\A[^\S\n]*---[^\S\n]*\n(?s:.*?\n)??[^\S\n]*---[^\S\n]*(?:\n|\z)\s*"


def without_front(text: Column) -> Column:
    """The text after a frontmatter whose very first line is the mark alone."""
    return F.regexp_replace(text, WHOLE_FRONT, "")


def validated(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds has_front and `faults`, the list of fields that are missing or wrong."""
    keep = docs.columns
    df = docs.withColumn("_front", frontmatter(F.col(text_col)))
    front = F.coalesce(F.col("_front"), F.lit(""))
    faults = F.array_compact(
        F.array(
            F.when(F.col("_front").isNull(), F.lit("frontmatter")),
            F.when(front_value(front, "source") == "", F.lit("source")),
            F.when(~front_value(front, "last_update_date").rlike(DAY), F.lit("last_update_date")),
            F.when(~front_value(front, "document_type").isin(KINDS), F.lit("document_type")),
        )
    )
    return df.select(*keep, F.col("_front").isNotNull().alias("has_front"), faults.alias("faults"))


def header_level(line: Column) -> Column:
    """1 to 6 for a line of that many # and a blank or its end, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})(?= |$)", 1))


def chunks(docs: DataFrame, id_col: str, text_col: str, level: int = 2) -> DataFrame:
    """(id, position, header, header_level, text, token_count): a chunk from each header of level 2 to `level` on.

    Level-1 headers never cut, code fences are not looked at, and whatever stands before the first
    header, be it one blank line, is a chunk without header; so is a whole text in which no header has a title.
    Frontmatter is taken off first. The token count is of the text before it is
    trimmed.
    """
    if not 2 <= level <= 4:
        raise ValueError("chunk levels are 2 to 4")
    body = docs.select(id_col, without_front(F.col(text_col)).alias("_body"))
    # a header needs a title: without one in the whole text nothing is cut; that is asked once, outside the lines
    cut = F.col("_body").rlike(rf"(?m)^#{{2,{level}}} .+$")
    line = lambda x, level: F.struct(x.alias("line"), level.cast("int").alias("level"))
    leveled = F.transform(F.split("_body", "\n"), lambda x: line(x, F.when(header_level(x).between(2, level), header_level(x)).otherwise(0)))
    lines = body.select(id_col, F.when(cut, leveled).otherwise(F.transform(F.split("_body", "\n"), lambda x: line(x, F.lit(0)))).alias("_l"))
    n = F.size("_l")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get("_l", i - 1)["level"] > 0))
    df = lines.withColumn("_s", starts)
    parts = F.transform("_s", lambda s, k: F.struct(k.alias("position"), F.slice("_l", s, F.coalesce(F.get("_s", k + 1), n + 1) - s).alias("lines")))
    df = df.select(id_col, F.inline(parts))
    first = F.get("lines", F.lit(0))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return df.select(
        id_col,
        "position",
        F.when(first["level"] > 0, T.trim_all(F.regexp_replace(first["line"], "^#+", ""))).otherwise("").alias("header"),
        first["level"].alias("header_level"),
        T.trim_all(body).alias("text"),
        F.size(F.regexp_extract_all(body, F.lit(r"\S+"), 0)).alias("token_count"),
    )


def chunk_count(text: Column, level: int = 2) -> Column:
    """How many chunks chunks() makes of a text; null for null."""
    body = without_front(text)
    starts = F.size(F.filter(F.slice(F.split(body, "\n"), 2, 1_000_000_000), lambda x: header_level(x).between(2, level)))
    return F.when(text.isNull(), None).when(body.rlike(rf"(?m)^#{{2,{level}}} .+$"), starts + 1).otherwise(1)


def with_ids(chunked: DataFrame, document_id: str) -> DataFrame:
    """Adds chunk_id: the uuid5 of position and header in the document's id."""
    return chunked.withColumn("chunk_id", T.uuid5_in(F.col(document_id), F.concat(F.col("position").cast("string"), F.lit(":"), F.col("header"))))


def stats(chunked: DataFrame, id_col: str) -> DataFrame:
    n = F.col("token_count")
    return chunked.groupBy(id_col).agg(F.count("*").alias("n_chunks"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("mean"), F.max(n).cast("long").alias("most"), F.min(n).cast("long").alias("least"))


def largest(chunked: DataFrame, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy(id_col).orderBy(F.desc("token_count"), "position")
    return chunked.withColumn("size_rank", F.row_number().over(order)).where(F.col("size_rank") <= k)


def document_fields(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds version, updated (null if it is no date) and `known`, whether the kind is one of KINDS, from the frontmatter."""
    front = F.coalesce(frontmatter(F.col(text_col)), F.lit(""))
    day = front_value(front, "last_update_date")
    return docs.withColumn("version", front_value(front, "source")).withColumn("updated", F.when(day.rlike(DAY), F.try_to_date(day, "yyyy-MM-dd"))).withColumn("known", front_value(front, "document_type").isin(KINDS))
