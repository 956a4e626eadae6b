"""The best k of each query inside a task, exact in value and order, of scores that come in pieces as matrices."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds doubles: half up of the shortest decimal form."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.abs(values) * 10.0**digits
        low, high = np.floor(x * (1 - 1e-14) + 0.5 - 1e-6), np.floor(x * (1 + 1e-14) + 0.5 + 1e-6)
        out = np.copysign(low / 10.0**digits, values)
    unit = Decimal(1).scaleb(-digits)
    for k in np.flatnonzero((low != high) | (x > 1e15)):
        v = float(values[k])
        out[k] = float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) if abs(v) < 1e15 else v
    return out + 0.0


class Best:
    """Of each of `n` queries the k highest values, and of equal values the smaller places; NaN is the highest."""

    def __init__(self, n: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.least = np.full(n, -np.inf)
        self.query, self.value, self.place = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def possible(self, scores: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of all scores (query by candidate, wrong by `error` at most) that may be among the best once they are rounded."""
        least = self.least
        if scores.shape[1] > self.k and np.isneginf(least).any():
            at = scores.shape[1] - self.k
            least = np.maximum(least, np.partition(scores, at, axis=1)[:, at])
        return np.nonzero(scores >= (least - 1.1 * 10.0**-self.digits - 2 * error)[:, None])

    def add(self, query: np.ndarray, value: np.ndarray, place: np.ndarray) -> None:
        """Values that are not rounded yet, each pair of a query and a place once at most."""
        q, v, p = np.concatenate([self.query, query]), np.concatenate([self.value, rounded(value, self.digits)]), np.concatenate([self.place, place])
        order = np.lexsort((p, -np.where(np.isnan(v), np.inf, v), q))
        q, v, p = q[order], v[order], p[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        full = rank == self.k - 1
        self.least[q[full]] = np.where(np.isnan(v[full]), np.inf, v[full])
        kept = rank < self.k
        self.query, self.value, self.place = q[kept], v[kept], p[kept]
