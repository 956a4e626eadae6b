"""The corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, and all but the last return the columns of their input. `run` applies them to the
table `documents`, writing each stage's result to the shared folder and reading it back, so that
a lost executor costs one stage at most. What a stage wrote for itself is deleted when its result stands.

SQL cannot express these stages, so ORACLE_SQL is None; tests compare them with plain versions.

Rows: an empty table gives an empty result at every stage. Rows with a null id are scored, are never
duplicates and are packed; null texts count as empty, and are dropped by the language stage as
any text without letters is. Rows that share an id are one document: they are kept or dropped by the
near-duplicate stage together, never mark each other's passages, and are packed each by itself.
Columns besides the id and the text are carried through all stages but the last, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import common, language, ngram_join, packing, suffix_dedup, toxicity

ORACLE_SQL = None

TOXIC = 0.3
#: A text whose ranks are so far from every language's is in none of them; 1 is a language's own order.
MIN_SCORE = 0.25


def _rest(docs: DataFrame) -> tuple[str, ...]:
    return tuple(x for x in docs.columns if x != "doc_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; learned from the labels that op4 may learn from."""
    network = toxicity.fit(docs, common.table(spark, sf_dir, "labels"), "toxic", common.bucket(F.col("doc_id"), 4) != 2)
    score = common.fresh(docs, "score")
    return toxicity.score(docs, network, keep=_rest(docs), out=score).where(F.col(score) < TOXIC).select(docs.columns)


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: one that is found, with a score of MIN_SCORE or more."""
    known = language.profiles(docs, common.bucket(F.col("doc_id"), 5) != 0)
    names = common.fresh(docs, "lang_pred"), common.fresh(docs, "score")
    found = language.identify(docs, known, keep=_rest(docs), out=names)
    return found.where((F.col(names[0]) != language.UNKNOWN) & (F.col(names[1]) >= MIN_SCORE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id."""
    linked = ngram_join.link(docs)
    gone = common.save(linked.where("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct())
    return ngram_join.among(docs, "doc_id", gone, "left_anti").select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that an earlier document has; halves of characters go too."""
    keep = _rest(docs)
    cut = suffix_dedup.remove_repeats(docs, form="text", keep=keep)
    named = {x: F.col(f"c{k}") for k, x in enumerate(keep)} | {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(named[x].alias(x) for x in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, as op6 gives them."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_foreign),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    first = common.saved()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.save(docs)
            common.let_go(spark, first, common.saved() - 1)
    return docs
