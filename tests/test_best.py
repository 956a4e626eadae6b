"""The best of each query from blocks of matrices against plain versions."""

from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators import bm25, cost, vectors
from siftstone.operators.best import Best, rounded


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(3)
    some = [0.1234565, -0.1234565, 2.5e-7, 5e-7, 1e300, math.inf, -math.inf, math.nan, 0.0, 123456.7890125, *(k / 1e7 for k in range(5, 2000, 10)), *(rng.gauss(0, 100) for _ in range(200))]
    want = [r[0] for r in spark.createDataFrame([(float(x),) for x in some], "x double").select(F.round("x", 6)).collect()]
    assert all(a == b or a != a and b != b for a, b in zip(rounded(np.array(some), 6).tolist(), want, strict=True))


def test_best_keeps_smaller_places_of_equal_values():
    best = Best(2, 2, 6)
    best.add(np.array([0, 0, 0, 1]), np.array([0.3, 0.30000001, 0.3, math.nan]), np.array([5, 9, 7, 1]))
    rows, cols = best.possible(np.array([[0.3, 0.2], [0.9, 0.1]]), 1e-12)
    assert (0, 0) in zip(rows, cols, strict=True) and (0, 1) not in zip(rows, cols, strict=True)
    best.add(np.array([0, 1]), np.array([0.3, 0.9]), np.array([2, 3]))
    assert list(zip(best.query, best.place, strict=True)) == [(0, 2), (0, 5), (1, 1), (1, 3)]


@pytest.mark.parametrize("block", [3, 1000])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, block):
    """Ties, copies, vectors of other sizes, with nulls, NaN and infinities, in one block or many; no loop over pairs of rows in the plan."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 0.4) for _ in range(4)]) for k in range(40)]
    rows += [(100 + k, rows[k % 3][1]) for k in range(12)]
    rows += [(200, [0.1, None, 0.2, 0.3]), (201, [math.nan, 0.0, 0.0, 0.0]), (202, [math.inf, 0.0, 0.0, 0.0]), (203, [1.0, 0.0]), (204, []), (205, None), (206, [1e200, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = df.where("id % 4 = 0 or id >= 200")

    def like(x, y):
        if None in x or None in y:
            return 0.0
        d = 0.0
        for a, b in zip(x, y, strict=True):
            d += (b - a) * (b - a)
        s = 1 - d / 2
        return s if s != s else float(Decimal(repr(max(0.0, s))).quantize(Decimal("0.000001"), ROUND_HALF_UP))

    want = set()
    for q, x in rows:
        if x is None or q % 4 and q < 200:
            continue
        near = sorted(((like(x, y), i) for i, y in rows if y is not None and len(y) == len(x)), key=lambda p: (-math.inf if p[0] != p[0] else -p[0], p[1]))
        want |= {(q, i, repr(s), n) for n, (s, i) in enumerate(near[:5], 1)}
    got = vectors.nearest(queries, df, 5, "id", "v", "id", "v")
    assert {(r.query_id, r.id, repr(r.similarity), r["rank"]) for r in got.collect()} == want
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


@pytest.mark.parametrize(("tokens", "queries"), [(20, 3), (1 << 20, 4096)])
def test_search_in_blocks_is_that_of_all_scores(spark, monkeypatch, tokens, queries):
    """No row for each pair of a query and a text, and the same ranks; copies, empty and null texts, queries without words, a grid of settings."""
    monkeypatch.setattr(bm25, "TOKENS_OF_BLOCK", tokens)
    monkeypatch.setattr(bm25, "QUERIES", queries)
    rng = random.Random(9)
    word = lambda: rng.choice(["red", "fox", "blue", "dog", "cat", "the", "the", "the", "owl", "élan"])
    texts = [" ".join(word() for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), *((100 + k, texts[k % 5]) for k in range(10)), (200, ""), (201, None)], "id long, text string")
    asked = spark.createDataFrame([*((k, " ".join(word() for _ in range(5))) for k in range(8)), (50, ""), (51, "nowhere"), (52, None)], "q long, t string")
    grid = ((1.6, 0.8), (1.2, 0.45))
    i = bm25.index(docs, "id", "text")
    got = bm25.best(asked, i, "q", "t", 4, grid)
    found = {(r.setting, r.query_id, r.id, r.score, r["rank"]) for r in got.collect()}
    assert found == {(n, r.query_id, r.id, r.score, r["rank"]) for n, (k1, b) in enumerate(grid) for r in bm25.ranked(bm25.scores(asked, i, "q", "t", k1, b), 4).collect()}
    assert "HashAggregate(keys=[query_id" not in plan(got).split("FlatMapCoGroupsInArrow")[0]


def test_calls_of_one_model_do_not_meet_in_one_task(spark):
    calls = spark.createDataFrame([("gpt-5#high",), ("unknown",), (None,)], "m string")
    book = spark.createDataFrame([("gpt-5", 1.0, 2.0, 0.5, False)], "model string, prompt double, completion double, ratio double, separate boolean")
    df = cost.priced(calls, book, "m")
    assert sorted((r.m or "", r.prompt_rate) for r in df.collect()) == [("", 0.002), ("gpt-5#high", 1.0), ("unknown", 0.002)]
    assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)


def test_hops_and_their_statement_meet_headers_by_likeness(spark, tmp_path):
    """A header that is like a benchmark text, and not only like a title, is a hit of the second hop in the query and in its SQL."""
    import duckdb

    from siftstone import queries as core

    body = "red fox over the blue hill and the green river to the old mill"
    docs = [(3, "Alpha\nred fox", "a"), (6, "Beta\nblue hill", "a"), (9, f"{body} far\ntext", "b"), (12, "Owl\nowl and cat", "b"), *((20 + k, f"{body} {k}x {k}y {k}z more of it\n", "c") for k in range(25))]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, body), (2, f"{body}s"), (4, f"{body} x")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = {tuple(r) for r in db.execute(core.oracle_sql()["hybrid_hops"]).fetchall()}
    assert {tuple(r) for r in core.queries()["hybrid_hops"](spark, str(tmp_path)).select("query_id", "id", "score", "hop", "rank").collect()} == want


def test_hops_make_vectors_once(spark):
    """However many searches, counts and joins read them, a chunk's vector is made once, and a query's once for each search."""
    from siftstone.plans import retrieval

    made, embedded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def noted(counter):
        def vector(text):
            counter.add(1)
            return [float(len(text)), 1.0]

        return F.udf(vector, "array<double>")

    chunks = spark.createDataFrame([(k, f"Head {k}", f"text {k} of red fox", "s") for k in range(12)], "id long, header string, text string, summary string").withColumn("vector", noted(made)("text"))
    embed = lambda q: q.withColumn("vector", noted(embedded)("text"))
    judge = lambda queries, contexts: ['{"can_answer": false, "reasoning": "r", "missing_query": "Head 9, red fox"}'] * len(queries)
    over = retrieval.corpus(chunks, "id", "header", "text", "summary", "vector")
    queries = spark.createDataFrame([(k, f"fox {k}") for k in range(5)], "query_id long, text string")
    assert retrieval.hybrid_hops(queries, over, embed, judge, k=4, hop_k=2).count() == 5 * 5
    assert (made.value, embedded.value) == (12, 10)


def test_letters_of_any_text(spark):
    from siftstone.queries.retrieval import LETTERS, _letters

    texts = ["Tea Oats tEE", "", None, "été İt\n\0tea", "xyz", "e"]
    got = {r.id: r.vector for r in _letters(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)).collect()}
    assert got[2] == [None] * len(LETTERS)
    for k, t in enumerate(texts):
        if t is not None:
            n = [t.lower().count(a) for a in LETTERS]
            assert got[k] == [x / max(1.0, math.sqrt(sum(y * y for y in n))) for x in n]
