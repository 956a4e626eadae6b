"""Quality classifier: a factorisation machine over words, structure and metadata.

Features of a text: its words hashed into WORD_BINS bins (counts, scaled to length 1 as a
vector), and one 1 for the bin of each structure figure (line, word, symbol, case and repetition
shares) and of its metadata (sizes in words, characters and bytes a character). The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2))

so all pairs of features interact through FACTORS numbers each, in time linear in the text.
The model is fitted in numpy on the driver from at most 2 * FIT_ROWS labelled rows of at most
common.FIT_CHARS characters, whose features come from the executors; every text is scored whole.

Rows: null text is empty; an empty text has its structure features only. Null or other labels than
0 and 1 are passed over. Without a label of either kind every score is 0.5. Repeated rows get equal
scores, very long texts are read whole, an empty table gives an empty result, and extra columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

WORD_BINS = 1 << 15
FACTORS = 8
#: At most so many rows of each label value are fitted on.
FIT_ROWS = 4000
EPOCHS = 6
BATCH = 64
RATE = 0.05
SEED = 7

#: Structure and metadata figures: name and the edges of its bins.
FIGURES: dict[str, list[float]] = {
    "words": [1, 5, 10, 20, 50, 100, 300, 1000, 3000],
    "characters": [1, 50, 200, 1000, 5000, 20000],
    "bytes_per_character": [1.0001, 1.01, 1.03, 1.1, 1.5, 2.5],
    "characters_per_word": [2, 3, 4, 5, 6, 7, 9, 12],
    "words_per_line": [1.5, 3, 6, 12, 25, 50, 100, 300],
    "symbol_share": [0.0001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4],
    "upper_share": [0.0001, 0.005, 0.02, 0.05, 0.1, 0.3, 0.6],
    "digit_share": [0.0001, 0.003, 0.01, 0.05, 0.2],
    "punctuation_share": [0.0001, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3],
    "repeated_neighbours": [0.0001, 0.01, 0.03, 0.1, 0.3, 0.6],
    "distinct_share": [0.1, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.95],
    "repeated_lines": [0.0001, 0.05, 0.2, 0.5],
    "bar_share": [0.0001, 0.01, 0.05, 0.15, 0.3],
}
STARTS = dict(zip(FIGURES, np.cumsum([WORD_BINS, *(len(x) + 1 for x in FIGURES.values())]), strict=False))
SIZE = WORD_BINS + sum(len(x) + 1 for x in FIGURES.values())


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(x) for x in chars]] = True
    return out


SYMBOLS, DIGITS, POINTS = _mask("#*$%&<>@^~_=+\\/{}[]"), _mask("0123456789"), _mask(".,;:!?'\"()-")
UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, offsets of each row) of a block of texts, rows' features in order."""
    n = len(offsets) - 1
    start, end, row = c.words(data, offsets)
    sums = c.prefix_sums(data)
    word = c.span_hash(sums, start, end)
    count = np.bincount(row, minlength=n)
    key = row * WORD_BINS + (c.mix(word) % np.uint64(WORD_BINS)).astype(np.int64)
    key.sort()
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(cut, len(key))).astype(np.float32)
    bin_row, bin_at = key[cut] // WORD_BINS, key[cut] % WORD_BINS
    norm = np.sqrt(np.bincount(bin_row, times**2, n))
    value = times / norm[bin_row].astype(np.float32)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, chars)

    chars = c.char_counts(data, offsets)
    size = np.diff(offsets)
    newline = np.concatenate([[0], np.cumsum(data == 0x0A)])
    lines = newline[offsets[1:]] - newline[offsets[:-1]] + 1
    line_start = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(data == 0x0A) + 1]))
    line_end = np.append(line_start[1:], len(data))
    line_row = np.minimum(np.searchsorted(offsets, line_start, "right") - 1, n - 1)
    full = line_end - line_start > 1
    line_key = np.stack([line_row[full].astype(np.uint64), c.span_hash(sums, line_start[full], line_end[full])])
    distinct_lines = np.bincount(np.unique(line_key, axis=1)[0].astype(np.int64), minlength=n) if full.any() else np.zeros(n)
    all_lines = np.bincount(line_row[full], minlength=n)
    same = np.bincount(row[1:], (word[1:] == word[:-1]) & (row[1:] == row[:-1]), n) if len(row) else np.zeros(n)
    figures = {
        "words": count,
        "characters": chars,
        "bytes_per_character": size / np.maximum(1, chars),
        "characters_per_word": chars / np.maximum(1, count),
        "words_per_line": count / lines,
        "symbol_share": share(SYMBOLS[data]),
        "upper_share": share(UPPER[data]),
        "digit_share": share(DIGITS[data]),
        "punctuation_share": share(POINTS[data]),
        "repeated_neighbours": same / np.maximum(1, count),
        "distinct_share": np.bincount(bin_row, minlength=n) / np.maximum(1, count),
        "repeated_lines": 1 - distinct_lines / np.maximum(1, all_lines),
        "bar_share": share(data == 0x7C),
    }
    at = np.stack([STARTS[k] + np.searchsorted(edges, figures[k], "right") for k, edges in FIGURES.items()], 1)
    rows = np.concatenate([bin_row, np.repeat(np.arange(n), len(FIGURES))])
    order = np.argsort(rows, kind="stable")
    feature = np.concatenate([bin_at, at.ravel()])[order]
    value = np.concatenate([value, np.ones(n * len(FIGURES), np.float32)])[order]
    return feature.astype(np.int32), value, np.searchsorted(rows[order], np.arange(n + 1))


class Machine:
    def __init__(self, factors: int = FACTORS, seed: int = SEED):
        self.w0 = np.float32(0)
        self.w = np.zeros(SIZE, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SIZE, factors)).astype(np.float32)

    def parts(self, feature: np.ndarray, value: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum before the sigmoid, v_i x_i, sum of v_i x_i of each row)."""
        vx = self.v[feature] * value[:, None]
        total = np.add.reduceat(vx, ends[:-1])
        square = np.add.reduceat(vx * vx, ends[:-1])
        linear = np.add.reduceat(self.w[feature] * value, ends[:-1])
        return self.w0 + linear + 0.5 * (total**2 - square).sum(1), vx, total

    def score(self, feature: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(feature, value, ends)[0].astype(np.float64), -30, 30)))

    def fit(self, feature: np.ndarray, value: np.ndarray, ends: np.ndarray, label: np.ndarray, seed: int = SEED) -> None:
        """Adagrad over shuffled batches, both label values weighing the same."""
        rng = np.random.default_rng(seed)
        weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
        g0, gw, gv = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                size = ends[rows + 1] - ends[rows]
                at = c.ranges(ends[rows], size)
                f, x, e = feature[at], value[at], np.concatenate([[0], np.cumsum(size)])
                y, vx, total = self.parts(f, x, e)
                d = ((1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[rows]) * weight[rows] / len(rows)).astype(np.float32)
                each = np.repeat(d, size)[:, None]
                own, where = np.unique(f, return_inverse=True)
                dw, dv = np.zeros(len(own), np.float32), np.zeros((len(own), self.v.shape[1]), np.float32)
                np.add.at(dw, where, each[:, 0] * x)
                np.add.at(dv, where, each * x[:, None] * (np.repeat(total, size, 0) - vx))
                dw += 1e-5 * self.w[own]
                dv += 1e-5 * self.v[own]
                g0 += float(d.sum()) ** 2
                gw[own] += dw**2
                gv[own] += dv**2
                self.w0 -= np.float32(RATE * d.sum() / np.sqrt(g0))
                self.w[own] -= RATE * dw / np.sqrt(gw[own])
                self.v[own] -= RATE * dv / np.sqrt(gv[own])


def fit(docs: DataFrame, labels: DataFrame, flag: str, learn: Column, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine | None:
    """The machine, or None if a label value has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in c.blocks(batch.column(2)):
                feature, value, ends = features(data, offsets)
                at = pa.array(ends.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.ListArray.from_arrays(at, pa.array(feature)), pa.ListArray.from_arrays(at, pa.array(value))], ["label", "place", "feature", "value"])

    sample = c.labelled(docs, labels, flag, learn, rows, id_col, text_col)
    found = sample.mapInArrow(run, "label int, place long, feature array<int>, value array<float>").toArrow().sort_by([("place", "ascending"), ("label", "ascending")]).combine_chunks()
    label = found.column("label").to_numpy().astype(np.float32)
    if not len(label) or label.min() == label.max():
        return None
    lists = [found.column(k).combine_chunks() for k in ("feature", "value")]
    size = np.array([len(x) for x in lists[0]])
    machine = Machine()
    machine.fit(lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]), label)
    return machine


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each row."""
    spread = docs.sparkSession.sparkContext.broadcast(machine)

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for batch in batches:
            for lo, hi, data, offsets in c.blocks(batch.column(1)):
                found = own.score(*features(data, offsets)) if own else np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.select(id_col).dtypes[0][1]}, score double")
