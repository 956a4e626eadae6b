"""Pairs of strings of enough InDel ratio, without measuring all with all and without moving pairs.

A ratio of r means that the longest common subsequence of strings of n and m characters has at least L = r (n + m) / 200 of
them. So they have L characters in common, and as at most n - L characters go and m - L come, one that goes breaks two pairs of
neighbours and one that comes breaks one, 3 L - n - m - 1 pairs of neighbours are in both. Both hold as well where characters or
pairs are taken for one.

Strings meet in blocks of lengths that allow the ratio. Of counts x and y the smaller is at most sqrt(x y), so a product of matrices
of the roots of counts bounds what the strings of two blocks share; pairs that it leaves are counted, and only what is left then is
measured. What is moved are strings, each once for a block of the other side; pairs leave a task only when they are found.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import lcs_length, lcs_lengths
from ..sources.scratch import saved

#: Strings of a block of the left and of the right, and characters of either.
LEFT, RIGHT, CHARS = 16_384, 4_096, 1 << 23
#: Characters with a number of their own, and columns for them and for pairs of neighbours; rarer ones share these.
KNOWN, SINGLES, PAIRS = 1000, 64, 512
#: Left and right strings that are multiplied at once, characters of the latter, and pairs that are counted at once.
ROWS, COLUMNS, COLUMN_CHARS, COUNTED = 512, 2048, 1 << 20, 8192
#: Strings from which on they are measured with one string all at once.
MANY = 24
#: Partitions of the pairs of blocks at most.
PARTITIONS = 4096
FOUND = "l long, a string, b string, ratio double"
#: By how much a bound may be wrong in single precision, for a character.
SLACK = 1e-4


class _Strings:
    """Strings in the order of their lengths, as code points in a row."""

    def __init__(self, table: pa.Table):
        texts = table["s"].to_pylist()
        order = np.argsort(np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
        self.order, self.texts = order, [texts[i] for i in order]
        self.n = np.fromiter(map(len, self.texts), np.int64, len(texts))
        self.ends = np.cumsum(self.n)
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), "<u4")

    def code(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] - self.n[i] : self.ends[i]]

    def pieces(self) -> list[tuple[int, int]]:
        """Ranges of COLUMNS strings and COLUMN_CHARS characters at most, but for one longer string."""
        out, a = [], 0
        while a < len(self.n):
            before = self.ends[a] - self.n[a]
            b = max(a + 1, min(a + COLUMNS, int(np.searchsorted(self.ends, before + COLUMN_CHARS, "right"))))
            out.append((a, b))
            a = b
        return out


def _ranks(counts: np.ndarray) -> np.ndarray:
    """The place of each number by falling count, -1 where there is none."""
    out, met = np.full(len(counts), -1), np.flatnonzero(counts)
    out[met[np.argsort(-counts[met], kind="stable")]] = np.arange(len(met))
    return out


class _Bags:
    """Counts of the characters and of the pairs of neighbours that some strings have; what these have not is not counted."""

    def __init__(self, strings: _Strings):
        known, place, counts = np.unique(strings.codes, return_inverse=True, return_counts=True)
        self.number = np.full(0x110000, KNOWN, np.int32)
        self.number[known] = np.minimum(_ranks(counts), KNOWN - 1)
        # rare characters share a number, KNOWN is one that none of the strings has
        pair, _ = self._pairs(*self._numbers(strings, 0, len(strings.n)))
        rank = _ranks(np.bincount(pair, minlength=(KNOWN + 1) ** 2))
        self.column = np.where(rank < 0, -1, rank % PAIRS)

    def _numbers(self, strings: _Strings, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        codes = strings.codes[strings.ends[a] - strings.n[a] : strings.ends[b - 1]]
        return self.number[codes], np.repeat(np.arange(b - a), strings.n[a:b])

    @staticmethod
    def _pairs(number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = row[1:] == row[:-1]
        return (number[:-1] * np.int64(KNOWN + 1) + number[1:])[inside], row[1:][inside]

    def counts(self, strings: _Strings, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of characters and of pairs of the strings from a to b."""
        number, row = self._numbers(strings, a, b)
        pair, pair_row = self._pairs(number, row)
        out = []
        for size, column, rows in ((SINGLES, np.where(number < KNOWN, number % SINGLES, -1), row), (PAIRS, self.column[pair], pair_row)):
            has = column >= 0
            out.append(np.bincount(rows[has] * size + column[has], minlength=(b - a) * size).reshape(b - a, size).astype(np.int32))
        return out[0], out[1]


def _beside(counts: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """The roots of the counts, and more columns."""
    return np.column_stack([np.sqrt(counts, dtype=np.float32), *(np.asarray(c, np.float32) for c in columns)])


def _meeting(q: _Strings, h: _Strings, least: np.ndarray):
    """Pieces of the right, from and to, each with groups of the left and the part of the piece whose lengths allow enough: (from, to, from, to), the latter in the piece."""
    low, high = np.ceil(q.n * least / (200 - least) - 1e-6), np.floor(q.n * (200 - least) / least + 1e-6)
    for c, d in h.pieces():
        groups = []
        for a in range(0, len(q.n), ROWS):
            b = min(a + ROWS, len(q.n))
            x, y = np.searchsorted(h.n[c:d], low[a:b].min(), "left"), np.searchsorted(h.n[c:d], high[a:b].max(), "right")
            if x < y:
                groups.append((a, b, int(x), int(y)))
        if groups:
            yield c, d, groups


def _measured(q: _Strings, h: _Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs, which come in the order of i."""
    out = np.empty(len(i), np.int64)
    cuts = np.r_[0, np.flatnonzero(i[1:] != i[:-1]) + 1, len(i)] if len(i) else i
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        text = q.texts[i[a]]
        if b - a < MANY:
            out[a:b] = [len(text) if text == h.texts[k] else lcs_length(text, h.texts[k]) for k in j[a:b]]
        else:
            out[a:b] = lcs_lengths(q.code(i[a]), [h.code(k) for k in j[a:b]])
    return out


def _likeliest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each left string of a block the ratio to the right one that shares most pairs of neighbours for its length, by the bound."""
    q, h = _Strings(left), _Strings(right)
    value, place = np.full(len(q.n), -1.0, np.float32), np.zeros(len(q.n), np.int64)
    if len(q.n) and len(h.n):
        bags = _Bags(q)
        own = _beside(bags.counts(q, 0, len(q.n))[1])
        for c, d, groups in _meeting(q, h, left["least"].to_numpy()[q.order]):
            theirs = _beside(bags.counts(h, c, d)[1])
            for a, b, x, y in groups:
                share = own[a:b] @ theirs[x:y].T
                share /= (q.n[a:b, None] + h.n[c + x : c + y]).astype(np.float32)
                at = share.argmax(axis=1)
                best = share[np.arange(b - a), at]
                more = best > value[a:b]
                value[a:b][more], place[a:b][more] = best[more], (c + x + at)[more]
    has = np.flatnonzero(value >= 0)
    ratio = 200.0 * _measured(q, h, has, place[has]) / (q.n[has] + h.n[place[has]])
    return pa.table({"l": left["l"].take(pa.array(q.order[has])), "ratio": pa.array(ratio)})


def _enough(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs of two blocks whose ratio is at least the left string's least."""
    q, h = _Strings(left), _Strings(right)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(q.n) and len(h.n):
        least, bags = left["least"].to_numpy()[q.order], _Bags(q)
        singles, pairs = bags.counts(q, 0, len(q.n))
        # what is shared less what is needed, as one product: of characters least / 200 of both lengths, of pairs three times that less both and 1
        s, p = least / 200 - SLACK, 3 * least / 200 - 1 - SLACK
        own_s, own_p = _beside(singles, -s, -s * q.n + 0.01), _beside(pairs, -p, -p * q.n + 1.01)
        for c, d, groups in _meeting(q, h, least):
            their_singles, their_pairs = bags.counts(h, c, d)
            ones = np.ones(d - c)
            their_s, their_p = _beside(their_singles, h.n[c:d], ones), _beside(their_pairs, h.n[c:d], ones)
            kept = []
            for a, b, x, y in groups:
                i, j = np.nonzero((own_p[a:b] @ their_p[x:y].T >= 0) & (own_s[a:b] @ their_s[x:y].T >= 0))
                for k in range(0, len(i), COUNTED):
                    r, t = a + i[k : k + COUNTED], x + j[k : k + COUNTED]
                    both = q.n[r] + h.n[c + t]
                    need = np.ceil(least[r] * both / 200 - 1e-6).astype(np.int64)
                    for fits in (
                        lambda r, t, both, need: need <= np.minimum(q.n[r], h.n[c + t]),
                        lambda r, t, both, need: np.minimum(singles[r], their_singles[t]).sum(axis=1) >= need,
                        lambda r, t, both, need: np.minimum(pairs[r], their_pairs[t]).sum(axis=1) >= 3 * need - both - 1,
                    ):
                        ok = fits(r, t, both, need)
                        r, t, both, need = r[ok], t[ok], both[ok], need[ok]
                    kept.append((r, c + t))
            i, j = (np.concatenate([x[k] for x in kept]) if kept else np.empty(0, np.int64) for k in range(2))
            value = 200.0 * _measured(q, h, i, j) / (q.n[i] + h.n[j])
            ok = value >= least[i]
            found.append((i[ok], j[ok], value[ok]))
    i, j, value = (np.concatenate([f[k] for f in found]) for k in range(3))
    own, others = (x.take(pa.array(k)) for x, k in ((left, q.order[i]), (right, h.order[j])))
    return pa.table({"l": own["l"], "a": own["s"], "b": others["s"], "ratio": pa.array(value)})


def _blocks(left: DataFrame, right: DataFrame, least: float, run: Callable[[pa.Table, pa.Table], pa.Table], kinds: str) -> DataFrame:
    """What `run` makes of each pair of blocks of (l, s, n, least) and (s, n) whose lengths allow a ratio of `least`."""
    low, high = least / (200 - least), (200 - least) / least
    step = math.log(max(high, 1.25))

    def band(n: Column) -> Column:
        return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / step)

    first, last = band(F.ceil(F.col("n") * low - 1e-6)), band(F.floor(F.col("n") * high + 1e-6))
    x, y = left.withColumn("band", F.explode(F.sequence(first, F.greatest(first, last)))), right.withColumn("band", band(F.col("n")))

    def parts(df: DataFrame, name: str, rows: int) -> DataFrame:
        return df.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / rows, F.sum("n") / CHARS)).alias(name))

    # a row for each band, and there are as many bands as the logarithm of the longest length has steps
    bands = saved(parts(x, "parts_a", LEFT).join(parts(y, "parts_b", RIGHT), "band"))
    cells = bands.agg(F.sum(F.col("parts_a") * F.col("parts_b"))).first()[0] or 1
    cell = ["band", "a", "b"]

    def dealt(df: DataFrame, own: str, other: str, *columns: str) -> GroupedData:
        rows = df.join(F.broadcast(bands), "band").withColumn(own, F.pmod(F.xxhash64("s"), F.col(f"parts_{own}")))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"parts_{other}") - 1)))
        # by number, as small cells are much work and would be put into few tasks
        return rows.select(*(F.col(c).alias(c) for c in (*cell, *columns))).repartition(min(2 * cells, PARTITIONS), *cell).groupBy(*cell)

    return dealt(x, "a", "b", "l", "s", "least").cogroup(dealt(y, "b", "a", "s")).applyInArrow(lambda some, others: run(some, others), kinds)


def _strings(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(l, s, n, least, asked, given): the distinct strings of both, numbered, and which side has them."""
    sides = [df.select(F.col(name).alias("s"), F.lit(k == 0).alias("asked"), F.lit(k == 1).alias("given")) for k, (df, name) in enumerate(((left, a), (right, b)))]
    both = sides[0].union(sides[1]).where("s is not null").groupBy("s").agg(F.bool_or("asked").alias("asked"), F.bool_or("given").alias("given"))
    return saved(both.select(F.monotonically_increasing_id().alias("l"), "s", F.length("s").alias("n"), F.lit(float(least)).alias("least"), "asked", "given"))


def alike(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, r) of all distinct strings of the two columns, in any order, whose ratio is at least `least`, which is over 0 and at most 100.

    Empty strings are like empty ones only; nulls are like nothing.
    """
    strings = _strings(left, right, a, b, least)
    found = _blocks(strings.where("asked and n > 0"), strings.where("given and n > 0"), least, _enough, FOUND)
    empty = strings.where("asked and given and n = 0").select(F.col("s").alias(a), F.col("s").alias(b), F.lit(100.0).alias("r"))
    return found.select(F.col("a").alias(a), F.col("b").alias(b), F.col("ratio").alias("r")).union(empty)


def most_alike(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(a, b, r): of the pairs of `alike` those of each `a` with its highest r, of equal ones all.

    A string that the right has is most like that one. Of the others the likeliest partners are measured first, and what is
    less like than these is never measured.
    """
    strings = _strings(left, right, a, b, least)
    asked, given = strings.where("asked and not given and n > 0"), strings.where("given and n > 0")
    bars = _blocks(asked, given, least, _likeliest, "l long, ratio double").groupBy("l").agg(F.max("ratio").alias("bar"))
    barred = saved(asked.join(bars, "l", "left").withColumn("least", F.greatest("least", "bar")))
    order = Window.partitionBy("l").orderBy(F.desc("ratio"))
    found = _blocks(barred, given, least, _enough, FOUND).withColumn("at", F.rank().over(order)).where("at = 1")
    equal = strings.where("asked and given").select(F.col("s").alias(a), F.col("s").alias(b), F.lit(100.0).alias("r"))
    return found.select(F.col("a").alias(a), F.col("b").alias(b), F.col("ratio").alias("r")).union(equal)
