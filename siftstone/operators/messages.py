"""Messages and prompts in pieces, and a result cache over a log of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the longest message, what pieces are packed to, the longest field, the marker of prompts, how long a result is kept.
MESSAGE_CHARS, PACKED_CHARS, FIELD_CHARS = 2000, 1900, 1024
CACHE_MARK = "<!--CACHE_BREAK-->"
TTL_SECONDS = 300
BLANK = " \t\n\r\x0b\x0c"


def packed(text: Column) -> Column:
    """The messages of an answer: itself if it is short enough, else runs of whole sentences of up to PACKED_CHARS; a longer sentence stays whole."""
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(held: Column, sentence: Column) -> Column:
        piece = F.when(F.endswith(sentence, F.lit(".")), sentence).otherwise(F.concat(sentence, F.lit(".")))
        fits = F.length(held["now"]) + F.length(piece) <= PACKED_CHARS
        done = F.when(fits | (held["now"] == ""), held["done"]).otherwise(F.array_append(held["done"], F.btrim(held["now"], F.lit(BLANK))))
        return F.struct(done.alias("done"), F.concat(F.when(fits, held["now"]).otherwise(""), piece, F.lit(" ")).alias("now"))

    runs = F.aggregate(F.split(text, r"\. "), none, add, lambda x: F.array_append(x["done"], F.btrim(x["now"], F.lit(BLANK))))
    return F.when(F.length(text) <= MESSAGE_CHARS, F.array(text)).otherwise(runs)


def _folded(parts: Column, size: int, joint: str, tidy) -> Column:
    """Runs of parts of up to `size` characters; a longer part is cut hard, and stands alone."""
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(held: Column, part: Column) -> Column:
        closed = F.when(held["now"] == "", held["done"]).otherwise(F.array_append(held["done"], tidy(held["now"])))
        both = F.when(held["now"] == "", part).otherwise(F.concat(held["now"], F.lit(joint), part))
        starts = F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1)), F.lit(size))
        cut = F.struct(F.concat(closed, F.transform(starts, lambda k: tidy(F.substring(part, k, F.lit(size))))).alias("done"), F.lit("").alias("now"))
        fits = F.struct(held["done"].alias("done"), both.alias("now"))
        return F.when(F.length(part) > size, cut).when(F.length(both) <= size, fits).otherwise(F.struct(closed.alias("done"), part.alias("now")))

    return F.aggregate(parts, none, add, lambda x: F.when(x["now"] == "", x["done"]).otherwise(F.array_append(x["done"], tidy(x["now"]))))


def field_pieces(text: Column, size: int = FIELD_CHARS) -> Column:
    """A field's pieces of up to `size` characters: runs of whole sentences, trimmed; a sentence that is too long is cut hard."""
    parts = F.regexp_extract_all(text, F.lit(r"(?U)(?s:.*?)[.!?]+\s+|(?s:.+)"), 0)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(_folded(parts, size, "", lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))


def quote_pieces(text: Column, size: int = FIELD_CHARS) -> Column:
    """The same by lines, which keep their marks; a line that is too long is cut hard. Empty lines at a piece's beginning go."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(_folded(F.split(text, "\n"), size, "\n", lambda x: x))


def cache_blocks(text: Column) -> Column:
    """The blocks (text, cached) between a prompt's marks, but for empty ones; all that have a mark behind them can be cached."""
    parts = F.split(text, CACHE_MARK)
    blocks = F.transform(parts, lambda x, i: F.struct(F.btrim(x, F.lit(BLANK)).alias("text"), (i < F.size(parts) - 1).alias("cached")))
    blocks = F.filter(blocks, lambda x: x["text"] != "")
    whole = F.array(F.struct(text.alias("text"), F.lit(False).alias("cached")))
    return F.when((F.size(parts) == 1) | (F.size(blocks) == 0), whole).otherwise(blocks)


def without_marks(text: Column) -> Column:
    return F.btrim(F.replace(text, F.lit(CACHE_MARK), F.lit("")), F.lit(BLANK))


def cache_key(query: Column, context: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.btrim(F.lower(query), F.lit(BLANK)), context), 256)


def cache_trace(requests: DataFrame, query: str, context: str, ts: str, request_id: str, ttl: float = TTL_SECONDS) -> DataFrame:
    """(context, request id, hit): whether a request's result is still kept when it comes; a miss keeps it anew.

    A key's requests come sorted in one task, which reads them batch by batch and carries one time over. Null times come first and miss.
    """
    rows = requests.select(F.col(context).alias("x"), F.col(request_id).alias("e"), cache_key(F.col(query), F.col(context)).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    kinds = dict(rows.dtypes)
    limit = int(ttl * 1_000_000)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, until = None, None
        for pdf in frames:
            hits = []
            for k, t, known in zip(pdf["k"], pdf["t"], pdf["t"].notna(), strict=True):
                hit = known and k == now and until is not None and t <= until
                if not hit:
                    now, until = k, t + limit if known else None
                hits.append(bool(hit))
            yield pd.DataFrame({"x": pdf["x"], "e": pdf["e"], "hit": hits})

    out = rows.repartition("k").sortWithinPartitions("k", "t", "e").mapInPandas(run, f"x {kinds['x']}, e {kinds['e']}, hit boolean")
    return out.select(F.col("x").alias(context), F.col("e").alias(request_id), "hit")
