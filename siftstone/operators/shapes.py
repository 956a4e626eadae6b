"""Answers of models judged by the shape of their JSON, row by row.

Text becomes a VARIANT, so a field's presence, its type and the shape of a list's elements are asked of the
tree itself; nothing is lost to a schema that does not fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the fields of an answer, those of a quote, those that may not be blank, and those that a judge does not see.
FIELDS = ["smalltalk", "short_answer", "persona_short_answer", "quotes", "explanation", "persona_afterword"]
QUOTE_FIELDS = ["quote_title", "quote_text"]
FILLED = ["short_answer", "persona_short_answer", "persona_afterword"]
PERSONA = ["persona_short_answer", "persona_afterword"]
BLANK = r"(?U)^\s*$"


def _at(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit(kind))


def _faulty_text(v: Column, name: str) -> Column:
    """Whether a field that is there is no text, or blank."""
    x = _at(v, name)
    return x.isNotNull() & (~_is(x, "STRING") | F.coalesce(x.cast("string").rlike(BLANK), F.lit(True)))


def shaped(rows: DataFrame, json: str) -> DataFrame:
    """Adds `quotes` (a list of VARIANT, or null) and `faults`, in the order in which they are looked for.

    "json": no JSON at all. "missing:x": a required field is not there; null counts as there. "quotes:json", "quotes:list":
    quotes given as text are read again, without commas at their end; what is no list then is refused. "quote:i": an element
    that is no object with title and text. "blank:x", "blank:i:x": a text that has to be filled is blank or no text. What comes
    after a fault of an earlier kind is not looked at.
    """
    df = rows.withColumn("_v", F.try_parse_json(F.col(json)))
    inner = _at(F.col("_v"), "quotes")
    text = F.regexp_replace(F.regexp_replace(inner.cast("string"), r"(?U)\s+$", ""), ",+$", "")
    df = df.withColumn("_q", F.when(_is(inner, "STRING"), F.try_parse_json(text)).otherwise(inner))
    df = df.withColumn("_list", F.when(_is(F.col("_q"), "ARRAY"), F.col("_q").cast("array<variant>")))
    v = F.col("_v")
    missing = F.array_compact(F.array(*(F.when(_at(v, x).isNull(), F.lit(f"missing:{x}")) for x in FIELDS)))
    whole = F.array_compact(F.array(F.when(F.col("_q").isNull(), F.lit("quotes:json")).when(F.col("_list").isNull(), F.lit("quotes:list"))))
    number = lambda i: F.concat(F.lit("quote:"), i.cast("string"))
    lacks = lambda x: reduce(lambda a, b: a | b, [_at(x, k).isNull() for k in QUOTE_FIELDS])
    parts = F.array_compact(F.transform("_list", lambda x, i: F.when(lacks(x), number(i))))
    blank = F.array_compact(F.array(*(F.when(_faulty_text(v, x), F.lit(f"blank:{x}")) for x in FILLED)))
    of = lambda x, i: F.array_compact(F.array(*(F.when(_faulty_text(x, k), F.concat(F.lit("blank:"), i.cast("string"), F.lit(f":{k}"))) for k in QUOTE_FIELDS)))
    inside = F.concat(blank, F.flatten(F.transform("_list", of)))
    df = df.withColumns({"_missing": missing, "_parts": parts})
    faults = F.when(v.isNull(), F.array(F.lit("json"))).when(F.size("_missing") > 0, F.col("_missing")).when(F.col("_list").isNull(), whole).when(F.size("_parts") > 0, F.col("_parts")).otherwise(inside)
    return df.select(*rows.columns, F.col("_list").alias("quotes"), faults.alias("faults"))


def without_keys(json: Column, keys: list[str]) -> Column:
    """JSON text without some keys of its object, compact and by key; text that is no JSON object comes back as it is."""
    v = F.try_parse_json(json)
    rest = F.map_filter(v.cast("map<string, variant>"), lambda k, _: ~k.isin(keys))
    return F.when(_is(v, "OBJECT"), F.to_json(rest)).otherwise(json)


def for_judge(json: Column) -> Column:
    """What a judge sees of an answer: its persona is cut off."""
    return without_keys(json, PERSONA)


def plain_markdown(text: Column) -> Column:
    """Text without fences, code ticks, bold and italic marks, links, header marks, quote marks and rules."""
    steps = [
        (r"(?s)```(.*?)```", "$1"), (r"`([^`]+)`", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"\*(.+?)\*", "$1"), (r"_(.+?)_", "$1"),
        (r"\[([^\]]+)\]\([^\)]+\)", "$1"), (r"(?m)^#+\s+", ""), (r"(?m)^>\s+", ""), (r"(?m)^[*\-_]{3,}\s*$", ""),
    ]
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)
