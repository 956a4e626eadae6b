"""Exact nearest neighbours of a stated set of query vectors.

Every vector is compared with every query: blocks of queries meet blocks of vectors in one task each, as products of matrices.
A product only tells which pairs may be among the best; these are then measured one dimension after the other, so the values are
those of the plain sum of squares. Of each pair of blocks only a query's best k go on, and what is moved before are vectors, each once
for a block of the other side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .best import Best

#: Queries or vectors of a block.
BLOCK = 16_384
#: Of a pair of blocks, queries and vectors that are multiplied at once, and pairs that are measured at once.
QUERIES, VECTORS, PAIRS = 1024, 4096, 1 << 16


def _matrix(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one size as doubles, and which of them hold nulls, which are 0 here."""
    flat = pc.list_flatten(column).combine_chunks()
    gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(column), size)
    return flat.fill_null(0).to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), size), gaps.any(axis=1)


def _measured(q: np.ndarray, v: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """1 - squared distance / 2, not below 0 (the cosine of unit vectors), of rows in pairs, added up in the order of the dimensions; a null distance is no likeness."""
    total = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(q.shape[1]):
            x = v[:, k] - q[:, k]
            total += x * x
        return np.where(gap, 0.0, np.maximum(0.0, 1 - total / 2))


def _block(q: pa.Table, v: pa.Table, k: int, digits: int) -> pa.Table:
    """The best k of each query of a block among the vectors of another."""
    if not q.num_rows or not v.num_rows:
        q, v = q.slice(0, 0), v.slice(0, 0)
    v = v.take(pc.sort_indices(v["id"], null_placement="at_start"))
    size = q["size"][0].as_py() if q.num_rows else 0
    x, x_gap = _matrix(q["vec"], size)
    y, y_gap = _matrix(v["vec"], size)
    x_norm, y_norm = (x * x).sum(axis=1), (y * y).sum(axis=1)
    # Vectors with nulls, or too long for a product, are measured with all of the other side.
    x_odd, y_odd = x_gap | ~(x_norm < 1e100), y_gap | ~(y_norm < 1e100)
    groups = [(g[a : a + QUERIES], even) for g, even in ((np.flatnonzero(~x_odd), True), (np.flatnonzero(x_odd), False)) for a in range(0, len(g), QUERIES)]
    found = []
    for own, even in groups:
        best = Best(len(own), k, digits)

        def measure(rows: np.ndarray, cols: np.ndarray, best: Best = best, own: np.ndarray = own) -> None:
            for at in range(0, len(rows), PAIRS):
                r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
                best.add(r, _measured(x[own[r]], y[c], x_gap[own[r]] | y_gap[c]), c)

        for b in range(0, len(y), VECTORS):
            odd = y_odd[b : b + VECTORS] if even else np.ones(len(y[b : b + VECTORS]), bool)
            cols, rest = b + np.flatnonzero(~odd), b + np.flatnonzero(odd)
            if len(cols):
                scores = np.maximum(0.0, 1 - (x_norm[own, None] + y_norm[cols] - 2 * (x[own] @ y[cols].T)) / 2)
                rows, at = best.possible(scores, 1e-15 * (size + 8) * (x_norm[own].max() + y_norm[cols].max()))
                measure(rows, cols[at])
            step = max(1, PAIRS // len(own))
            for at in range(0, len(rest), step):
                some = rest[at : at + step]
                measure(np.repeat(np.arange(len(own)), len(some)), np.tile(some, len(own)))
        found.append((own[best.query], best.value, best.place))
    rows, values, places = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3))
    return pa.table({"query_id": q["query_id"].take(pa.array(rows)), "id": v["id"].take(pa.array(places)), "similarity": pa.array(values, pa.float64())})


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, query_vec: str, vec_id: str, vec: str, digits: int = 6) -> DataFrame:
    """(query_id, id, similarity, rank): nearest first, ties by id. Vectors of another size than the query's are not compared with it."""
    single = all(df.schema[x].dataType == S.ArrayType(S.FloatType(), df.schema[x].dataType.containsNull) for df, x in ((queries, query_vec), (vectors, vec)))
    kind = "array<float>" if single else "array<double>"

    def dealt(df: DataFrame, key: str, name: str, value: str, own: str, others: str, blocks: int, times: int) -> DataFrame:
        rows = df.select(F.col(key).alias(name), F.col(value).cast(kind).alias("vec"), F.size(value).alias("size")).where("size >= 0")
        return rows.withColumn(own, F.pmod(F.xxhash64(name), F.lit(blocks))).withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))

    n, m = (max(1, -(-df.count() // BLOCK)) for df in (queries, vectors))
    cell = ["size", "a", "b"]
    q = dealt(queries, query_id, "query_id", query_vec, "a", "b", n, m).groupBy(*cell)
    v = dealt(vectors, vec_id, "id", vec, "b", "a", m, n).groupBy(*cell)
    kinds = S.StructType([S.StructField("query_id", queries.schema[query_id].dataType), S.StructField("id", vectors.schema[vec_id].dataType), S.StructField("similarity", S.DoubleType())])
    found = q.cogroup(v).applyInArrow(lambda left, right: _block(left, right, k, digits), kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def at_least(found: DataFrame, least: float) -> DataFrame:
    """Hits of enough similarity; it goes after the cut at k, never below it."""
    return found.where(F.col("similarity") >= least)
