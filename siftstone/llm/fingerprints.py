"""Document fingerprints from closed syncmers of words, by built-in functions only.

A k-mer is K words in a row, its inner strings are the pairs of neighbouring words. It is a
closed syncmer if the least of its pairs by hash is the first or the last: that depends on
its own words alone, so a passage has the same anchors wherever it stands. `anchors` gives
them with their places. A fingerprint keeps the SIZE least anchor hashes, written as 16
hexadecimal digits each; likeness is the Jaccard estimate from the two fingerprints. Of a word of more
than LONG characters each character counts as a word, so that text without white space has anchors too
and loses only some of them by an edit.

Rows: null text is empty. A text with words but without a closed syncmer (all of up to K - 1
words, and some of K or K + 1) has one anchor, the whole of its words; only one without words
has none and an empty fingerprint. Two empty fingerprints are alike (1),
an empty and another one are not (0). Next documents go by ascending distinct id; of rows
that share an id the least text stands for it as a next document. Rows with a null id have no
next document: their text stays as it is and near_next is null. Texts are read whole however long they
are, equal texts (repeated rows) have equal fingerprints, an empty table gives an empty result, and extra
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from . import native

K = 5
SIZE = 64
LONG = 32


def _words(text: Column) -> Column:
    """The words, or for a text with long ones the words and the characters of the long ones."""
    found = native.words(text)
    apart = F.flatten(F.transform(found, lambda w: F.when(F.length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))
    return F.when(text.rlike(f"{native.WORD[:-1]}{{{LONG + 1}}}"), apart).otherwise(found)


def _pairs(words: str, out: str, df: DataFrame) -> DataFrame:
    df = df.withColumn(f"{out}_h", native.hashes(words))
    return df.withColumn(f"{out}_g", native.rolling(f"{out}_h", 2, lambda at: F.xxhash64(at(0), at(1))))


def _closed(at) -> Column:
    return F.least(at(0), at(3)) <= F.least(at(1), at(2))


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """The column `out`: the SIZE least distinct anchor hashes, ascending."""
    keep = df.columns
    df = _pairs("_w", "_s", df.withColumn("_w", _words(F.col(text))))
    found = native.rolling("_s_g", K - 1, lambda at: F.when(_closed(at), F.xxhash64(at(0), at(2), at(3))))
    short = F.when(F.size("_s_h") > 0, F.array(F.xxhash64("_s_h"))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_a", F.array_compact(found))
    df = df.withColumn("_a", F.when(F.size("_a") > 0, F.col("_a")).otherwise(short))
    return df.select(*keep, F.slice(F.sort_array(F.array_distinct("_a")), 1, SIZE).alias(out))


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word_place, anchor: every closed syncmer of each text of at least K words (places count as the words do)."""
    df = docs.select(F.col(id_col).alias("doc_id"), _words(native.whole(text_col)).alias("_w"))
    df = _pairs("_w", "_s", df)
    found = native.rolling("_s_g", K - 1, lambda at: F.when(_closed(at), F.xxhash64(at(0), at(2), at(3))))
    return df.select("doc_id", F.posexplode(found).alias("word_place", "anchor")).where("anchor is not null")


def written(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard estimate from two sketches."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next): each distinct non-null id and the one after it; the first after the last.

    The ids are dealt by range and written with their part's number; a window runs inside
    each part, and the parts' first ids, one row a part, close the gaps.
    """
    parts = c.save(ids.where("id is not null").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    first = parts.groupBy("part").agg(F.min("id").alias("first"))
    after = first.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"), F.min("first").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)).alias("least"))
    inside = parts.select("id", "part", F.lead("id").over(Window.partitionBy("part").orderBy("id")).alias("next"))
    return inside.join(F.broadcast(after), "part").select("id", F.coalesce("next", "after", "least").alias("next"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter overwritten by the next one's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    # an alias of a column to its own name would keep the shuffle below from being shared
    doc = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    rows = docs.select(doc, native.whole(text_col).alias("text"))
    sizes = c.save(rows.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")))
    order = c.save(next_ids(sizes.select("id")))
    quarter = sizes.groupBy("id").agg(F.max(F.floor(F.col("n") / 4)).alias("most"))
    asked = order.join(quarter, "id").select(F.col("id").alias("for_id"), F.col("next"), F.col("most"))
    # both sides of the last join read one shuffle of these rows, so they hold plain columns only
    held = rows.where("doc_id is not null")
    heads = held.join(asked, held["doc_id"] == asked["next"]).select("for_id", "text", F.expr("left(text, cast(most as int))").alias("head"))
    heads = with_sketch(heads, "text", "next_sketch").select("for_id", F.struct("text", "next_sketch", "head").alias("own"))
    if sizes.groupBy("id").count().where("count > 1").limit(1).count():
        heads = heads.groupBy("for_id").agg(F.min("own").alias("own"))
    heads = heads.select("for_id", F.col("own.next_sketch").alias("next_sketch"), F.col("own.head").alias("head"))
    alone = rows.where("doc_id is null").select("*", F.lit(None).cast("array<bigint>").alias("next_sketch"), F.lit(None).cast("string").alias("head"))
    both = held.join(heads, held["doc_id"] == heads["for_id"]).select("doc_id", "text", "next_sketch", "head").unionByName(alone)
    both = with_sketch(both, "text", "sketch").withColumn("n_chars", F.length("text").cast("long"))
    kept = F.expr("left(text, cast(n_chars - if(head is null, 0, floor(n_chars / 4)) as int))")
    edited = both.select("doc_id", "n_chars", "sketch", "next_sketch", F.concat(kept, F.coalesce(F.expr("left(head, cast(floor(n_chars / 4) as int))"), F.lit(""))).alias("edited"))
    out = with_sketch(edited, "edited", "edited_sketch")
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), written("sketch").alias("fingerprint"), written("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), F.when(F.col("next_sketch").isNotNull(), likeness("sketch", "next_sketch")).alias("near_next"))
