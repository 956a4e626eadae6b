"""Frontmatter as YAML.

Many documents share a block, so each distinct block is parsed once, in Arrow batches, and the documents are joined with
what was found; blocks of plain `key: value` lines go the same way, so there is one rule for all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import DAY, KINDS, frontmatter
from .sizes import small

UNKNOWN = "Unknown"


def plain(value: object) -> str | None:
    """A YAML value as text: days in ISO form, lists, maps and what else is no text as JSON; null stays null."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import yaml

    for batch in batches:
        fields, texts, faults = [], [], []
        for block in batch.column(0).to_pylist():
            try:
                found = yaml.load(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
            except (yaml.YAMLError, ValueError):
                found, fault = {}, "yaml"
            else:
                fault = None if isinstance(found, dict) else "mapping"
                found = found if isinstance(found, dict) else {}
            fields.append([(str(k), plain(v)) for k, v in found.items()])
            texts.append([str(k) for k, v in found.items() if isinstance(v, str)])
            faults.append(fault)
        names = pa.map_(pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fields, names), pa.array(texts, pa.list_(pa.string())), pa.array(faults, pa.string())], ["_front", "fields", "texts", "fault"])


def parsed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds `fields` (map of text), `texts` (names of fields that are text) and `fault`: "missing" without a block at the very start, "yaml" for bad YAML, "mapping" for what is none, else null."""
    df = docs.withColumn("_front", frontmatter(F.col(text_col)))
    blocks = df.select("_front").where("_front is not null").distinct().mapInArrow(_parse, "_front string, fields map<string, string>, texts array<string>, fault string")
    both = df.join(small(blocks), "_front", "left")
    return both.withColumn("fault", F.when(F.col("_front").isNull(), "missing").otherwise(F.col("fault"))).drop("_front")


def documents(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds version, updated, kind and `refused`: why no document can be made of a text, else null.

    The version is the field `source`, by default UNKNOWN; the day has to be a day, as text or of YAML's own, and the kind one of KINDS.
    """
    df = parsed(docs, text_col)
    day, kind = F.try_element_at("fields", F.lit("last_update_date")), F.try_element_at("fields", F.lit("document_type"))
    df = df.withColumn("version", F.when(F.map_contains_key("fields", "source"), F.try_element_at("fields", F.lit("source"))).otherwise(UNKNOWN))
    df = df.withColumn("updated", F.when(day.rlike(DAY), F.try_to_date(day, "yyyy-MM-dd"))).withColumn("kind", kind)
    text_kind = F.array_contains("texts", "document_type") & (kind != "")
    why = F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("updated").isNull(), "last_update_date").when(~F.coalesce(text_kind & kind.isin(KINDS), F.lit(False)), "document_type")
    return df.withColumn("refused", why)


def document_id(path: str):
    """The document's id: the uuid5 of its path in the URL namespace, a column."""
    return T.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.col(path))
