"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become whole numbers x = floor(1024 * c) + 100000, so sums, centring and the scatter are
exact and do not depend on the order in which tasks finish: each task multiplies vectors that are centred
by a whole number near the mean, Spark adds the products by their place in the matrix, and what is
left of the mean is taken off in whole numbers too. The matrix (bounded by the dimension, not by
the rows) is factored on the driver: Cholesky with diagonal pivots, then one-sided Jacobi rotations
of the columns of the triangular factor L. L J = U S has orthogonal columns; their squared norms are
the eigenvalues of L L' and the columns divided by their norms its eigenvectors.

Rows: a vector that is null or has a null or non-finite entry is left out, and so is one that has not the
length of most vectors (of equally many the longer). Repeated rows count each by itself, a null id stays null, extra
columns are not looked at. Directions without variance (beyond the numerical rank) are no components, so an empty
table, a single vector and equal vectors have no rows. An entry whose x is beyond 2**53 is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Whole numbers up to here are exact in doubles.
EXACT = float(1 << 53)


def whole_numbers(column: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of vectors in the column, or for the given one; only rows that count."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in [size] if size else np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        values = flat.to_numpy(zero_copy_only=False).reshape(-1, d)
        whole = np.isfinite(values).all(1)
        x = np.floor(SCALE * values[whole])
        if x.size and np.abs(x).max() >= EXACT:
            raise ValueError("an entry is too large for a whole number")
        yield rows[whole], x.astype(np.int64) + SHIFT


@c.tidy
def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in whole_numbers(batch.column(0)):
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, len(rows))), pa.array(x.sum(0))], ["d", "i", "n", "s"])


def products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers, exact while the sums are below 2**63."""
    if y.size and float(np.abs(y).max()) ** 2 * len(y) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64)
    if y.size and float(np.abs(y).max()) ** 2 * len(y) >= 2.0**63:
        raise ValueError("the vectors are spread too far for exact sums")
    return y.T @ y


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L'; L has as many columns as v has numerical rank."""
    a, d = v.copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(float(np.diag(v).max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for m in (a, factor):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated until they are orthogonal; each step rotates disjoint pairs, all at once."""
    g, r = factor.copy(), factor.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(sweeps if r > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            a, b = g[:, p], g[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            cosine = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > 1e-16
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            g[:, p], g[:, q] = cos * a - sin * b, sin * a + cos * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst < 1e-15 * np.sqrt(len(factor)):
            break
    return g


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling, and unit eigenvectors as columns) of a symmetric matrix without negative ones.

    The largest entry of each vector is positive.
    """
    factor, order = pivoted_cholesky(v)
    g = one_sided_jacobi(factor)
    norms = np.sqrt((g * g).sum(0))
    by = np.argsort(-norms, kind="stable")
    vectors = np.empty((len(v), len(by)))
    vectors[order] = g[:, by] / norms[by]
    lead = np.abs(vectors).argmax(0) if vectors.size else np.zeros(len(by), np.int64)
    return norms[by] ** 2, vectors * np.sign(vectors[lead, np.arange(len(by))])


@dataclass
class Model:
    """What the rows are projected with; bounded by the dimension."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, in whole numbers: of 64 bits where they fit, else Python's."""
        if x.size and self.n * float(np.abs(x).max()) + max(map(abs, self.sums)) >= 2.0**62:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return (z / self.n).astype(np.float64) @ self.components / np.sqrt(self.eigenvalues)


def deviations(z: np.ndarray) -> pa.Array:
    """Sums of squares of each row's whole numbers, exact."""
    kind = pa.decimal128(38, 0)
    if z.dtype != object and z.size and float(np.abs(z).max()) ** 2 * z.shape[1] >= 2.0**62:
        z = z.astype(object)
    total = (z * z).sum(1)
    return pa.array([int(t) for t in total], kind) if z.dtype == object else pa.array(total).cast(kind)


def fit(vectors: DataFrame, vector: str, most: int = COMPONENTS) -> Model | None:
    """The `most` largest components of all vectors that count, or None where there is no variance."""
    column = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    sums = column.mapInArrow(_sums, "d long, i long, n long, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    lengths = sums.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s")).where("n > 0")
    top = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not top:
        return None
    d, n, total = top[0].d, top[0].n, [int(x.s) for x in top[0].s]
    centre = np.array([s // n for s in total], np.int64)
    upper = np.triu_indices(d)

    @c.tidy
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((d, d), np.int64)
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), d):
                own += products(x - centre)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(own[upper])], ["i", "j", "s"])

    parts = column.mapInArrow(scatter, "i long, j long, s long").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rest = [s - n * int(m) for s, m in zip(total, centre, strict=True)]
    v = np.zeros((d, d))
    for r in parts.collect():
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.s) - rest[r.i] * rest[r.j]) / (n * n)
    values, components = eigen(v)
    if not len(values):
        return None
    k = min(most, len(values))
    return Model(n, total, values[:k], components[:, :k], values[:k] / np.trace(v))


def identity_error(column: DataFrame, model: Model) -> float:
    """Largest entry of the whitened vectors' covariance less the identity."""
    k, d = len(model.eigenvalues), len(model.sums)
    i, j = np.triu_indices(k)

    @c.tidy
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in whole_numbers(batch.column(0), d):
                w = model.whitened(model.centred(x))
                first, second = first + w.sum(0), second + w.T @ w
        rows = np.concatenate([i, np.full(k, -1)]), np.concatenate([j, np.arange(k)])
        yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.concatenate([second[i, j], first]))], ["i", "j", "s"])

    sums = {(r.i, r.j): r.s / model.n for r in column.mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(s - sums[-1, a] * sums[-1, b] - (a == b)) for (a, b), s in sums.items() if a >= 0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component."""
    kind = dict(vectors.dtypes)[id_col]
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(vectors, vector, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, d = len(model.eigenvalues), len(model.sums)
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v"), F.col(id_col).alias("vec_id"))
    error = identity_error(rows.select("v"), model)

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch.column(0), d):
                z = model.centred(x)
                again = pa.array(np.repeat(np.arange(len(at)), k))
                columns = [batch.column(1).take(pa.array(at)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, model.n)), deviations(z).take(again)]
                columns += [pa.array(model.whitened(z).ravel()), pa.array(np.tile(model.explained, len(at))), pa.array(np.full(len(at) * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
