"""Retrieval for a batch of queries: hybrid search, hops and final ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import answers, bm25, fusion, terms, vectors
from ..sources.scratch import saved

Judge = Callable[[DataFrame, DataFrame], DataFrame]
#: Adds `vector` to (query_id, text).
Embed = Callable[[DataFrame], DataFrame]
#: The raw JSON answers to a batch of (queries, contexts).
Provider = Callable[[list[str], list[str]], list[str]]


def hop(queries: DataFrame, index: bm25.Index, k: int, hop_number: int) -> DataFrame:
    found = bm25.best(queries, index, "query_id", "text", k).drop("setting")
    return found.withColumn("hop", F.lit(hop_number))


def multi_hop(queries: DataFrame, index: bm25.Index, judge: Judge, k: int = 15, hop_k: int = 5, max_hops: int = 1, final_k: int = 20) -> DataFrame:
    """(query_id, id, score, hop, rank).

    `judge` takes the queries and what they have so far, and returns (query_id, text) of what is still missing, a row
    for each query that cannot be answered yet. The loop is over hops, which are few and bounded; the
    queries of a hop run together. What a hop has found is saved, so it is searched for once.
    """
    have = saved(hop(queries, index, k, 0))
    for n in range(1, max_hops + 1):
        missing = judge(queries, have)
        fresh = hop(missing, index, hop_k, n).join(have.select("query_id", "id"), ["query_id", "id"], "left_anti")
        have = saved(have.unionByName(fresh))
    return fusion.reranked(have.withColumn("ordinal", F.col("hop") * 1_000_000 + F.col("rank")).drop("rank"), "score", "ordinal", final_k).drop("ordinal")


def header_hop(missing: DataFrame, chunks: DataFrame, index: bm25.Index | None, id_col: str, text_col: str, chunk: str, header: str, k: int = 5, search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score, place): what one hop brings for texts that list the missing titles.

    A title takes the first chunk of the header most like it, at that likeness less 0.01. The titles that no
    header is like are joined to one query for k texts, of BM25 or of `search`. Header hits come first, in the order of
    their titles, and of a chunk that comes again the first is kept.
    """
    asked = missing.select(F.col(id_col).alias("query_id"), F.posexplode(answers.titles(F.col(text_col))).alias("at", "title"))
    asked = asked.withColumn("key", F.struct("query_id", "at"))
    heads = saved(terms.header_lookup(asked, chunks, "key", "title", chunk, header, chunk))
    hits = heads.select("key.query_id", F.col("chunk").alias("id"), F.round(F.col("score") - 0.01, 6).alias("score"), F.col("key.at").alias("order"))
    rest = asked.join(heads.select("key"), "key", "left_anti").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "title"))), lambda x: x["title"]), ", ").alias("text"))
    found = search(rest) if search else bm25.best(rest, index, "query_id", "text", k)
    more = found.select("query_id", "id", "score", (F.col("rank") + 1_000_000).alias("order"))
    first = Window.partitionBy("query_id", "id").orderBy("order")
    once = hits.union(more).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("order"))).select("query_id", "id", "score", "place")


# -- hops over both lists ---------------------------------------------------------------------


@dataclass
class Corpus:
    """chunks (id, header, vector), saved, texts (id, text, summary) and the BM25 index of text, header and summary."""

    chunks: DataFrame
    texts: DataFrame
    index: bm25.Index


def corpus(chunks: DataFrame, id_col: str, header: str, text: str, summary: str, vector: str) -> Corpus:
    """One pass over the chunks makes tokens, headers and vectors, each once; after it only the texts that are shown to a judge are read."""
    names = {id_col: "id", header: "header", text: "text", summary: "summary", vector: "vector"}
    own = chunks.select(*(F.col(k).alias(v) for k, v in names.items()))
    index = bm25.index(own, "id", bm25.chunk_text("text", "header", "summary"), ("header", "vector"))
    return Corpus(index.words.select("id", "header", "vector"), own.select("id", "text", "summary"), index)


def retrieve(queries: DataFrame, over: Corpus, embed: Embed, k: int, least: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank) of (query_id, text): the k nearest vectors of enough similarity fused with the 2 k best of BM25.

    A query without any vector hit has no result. Queries are embedded once and saved, as both searches read them more than once.
    """
    asked = saved(embed(queries))
    near = vectors.at_least(vectors.nearest(asked, over.chunks, k, "query_id", "vector", "id", "vector"), least)
    text = bm25.best(asked, over.index, "query_id", "text", 2 * k)
    return fusion.hybrid(near, text, k).select("query_id", "id", F.col("relevance").alias("score"), "rank")


def verdicts(queries: DataFrame, have: DataFrame, over: Corpus, provider: Provider) -> DataFrame:
    """(query_id, can_answer, missing_query, failed): what the judge says of each query and the chunks that it has, in their order.

    A query's context is bounded by the hops' sizes. The provider is called in tasks, a batch of queries at a time. An answer that
    is no JSON, or has not both can_answer and reasoning, is a failure: that query goes on with what it has.
    """
    shown = have.join(over.texts, "id").select("query_id", F.struct("hop", "rank", "text", "summary").alias("c"))
    parts = F.transform(F.sort_array(F.collect_list("c")), lambda c, i: answers.hop_entry(i + 1, c["text"], c["summary"]))
    rows = queries.join(shown.groupBy("query_id").agg(F.array_join(parts, "\n").alias("context")), "query_id").select("query_id", "text", "context")
    kind = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = provider(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["query_id", "said"])

    v = F.try_parse_json("said")
    of = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    said = rows.mapInArrow(run, f"query_id {kind}, said string").withColumn("v", v)
    failed = F.col("v").isNull() | of("can_answer", "variant").isNull() | of("reasoning", "variant").isNull()
    return said.select("query_id", of("can_answer", "boolean").alias("can_answer"), of("missing_query", "string").alias("missing_query"), failed.alias("failed"))


def hybrid_hops(queries: DataFrame, over: Corpus, embed: Embed, provider: Provider, k: int = 15, hop_k: int = 5, max_hops: int = 1, final_k: int = 20, least: float = 0.0) -> DataFrame:
    """(query_id, id, score, hop, rank) of (query_id, text): hops over both lists with header hits first.

    The loop is over hops, a bounded few; all open queries of a hop run together. What a hop has found is saved, so a lost
    executor costs one hop at most and no judge is asked twice. So are the queries, which every step reads.
    """
    queries = saved(queries)
    have = saved(retrieve(queries, over, embed, k, least).withColumn("hop", F.lit(0)))
    left = queries
    for n in range(1, max_hops + 1):
        said = saved(verdicts(left, have, over, provider))
        asks = said.where("not failed and not can_answer and coalesce(missing_query, '') <> ''")
        left = left.join(asks.select("query_id"), "query_id", "left_semi")
        found = header_hop(asks, over.chunks, None, "query_id", "missing_query", "id", "header", search=lambda rest: retrieve(rest, over, embed, hop_k, least))
        fresh = found.join(have.select("query_id", "id"), ["query_id", "id"], "left_anti")
        have = saved(have.unionByName(fresh.select("query_id", "id", "score", F.col("place").alias("rank"), F.lit(n).alias("hop"))))
    return fusion.reranked(have.withColumn("ordinal", F.col("hop") * 1_000_000 + F.col("rank")).drop("rank"), "score", "ordinal", final_k).drop("ordinal")
