"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is a row of words (letters, digits and bytes beyond ASCII, lower-cased). Each word has two
inputs: an embedding of its hash, and the sum of embeddings of its character strings at either
end (of 3, 4 and 5 bytes in front, 3 behind), which lets unseen forms of a known stem speak. A
gated recurrent unit reads WINDOW words from either side, attention weighs its states, and their
weighted sum gives the window's score. Windows overlap by WINDOW - STRIDE words and the last one
ends with the text; a text's score is that of its worst window, so nothing is skipped however
long it is.

Training rows bear a label for the whole text. The first input of each embedding starts at the
smoothed log-odds of its bin among the training texts; then, for a few rounds, each toxic text
gives its worst window and the others their worst and some random windows, and the network is
fitted to these by backpropagation through time (Adam). At most 2 * FIT_ROWS texts are fitted on,
of at most common.FIT_CHARS characters each, in one order however the table lies in files.

Rows: null text is empty; a text without words has score 0. Null or other labels than 0 and 1 are
passed over. Without a label of either kind (an empty table) every score is 0. Repeated rows get
equal scores. Extra columns are kept on request and never looked at, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

WORD_BINS = 1 << 15
PART_BINS = 1 << 15
DIM = 6
HIDDEN = 8
WINDOW = 32
STRIDE = 24
#: At most so many texts of each label value are fitted on.
FIT_ROWS = 2500
ROUNDS = 3
EPOCHS = 3
BATCH = 64
#: Texts that the driver turns into numbers at once.
FIT_TEXTS = 100
SEED = 11
#: Parts of a word: bytes from its start (+) or end (-).
PARTS = (3, 4, 5, -3)

BLANK = np.ones(256, bool)
BLANK[0x80:] = BLANK[0x30:0x3A] = BLANK[0x41:0x5B] = BLANK[0x61:0x7B] = False


def inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input bins of each distinct word, which of them each word is, words of each row)."""
    data = c.lower_latin(data)
    start, end, row = c.words(data, offsets, BLANK)
    sums = c.prefix_sums(data)
    codes, distinct = pd.factorize(c.span_hash(sums, start, end).view(np.int64))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    a, b = start[first], end[first]
    bins = [c.mix(distinct.view(np.uint64)) % np.uint64(WORD_BINS)]
    for k, part in enumerate(PARTS):
        s, e = (a, np.minimum(b, a + part)) if part > 0 else (np.maximum(a, b + part), b)
        bins.append(c.mix(c.span_hash(sums, s, e) + np.uint64(k + 1)) % np.uint64(PART_BINS))
    return np.stack(bins, 1).astype(np.int32) if len(distinct) else np.zeros((0, 1 + len(PARTS)), np.int32), codes, np.bincount(row, minlength=len(offsets) - 1)


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of the windows of rows with so many words."""
    n = np.where(count == 0, 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)))
    row = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(count[row], WINDOW)
    return row, np.minimum(k * STRIDE, count[row] - size), size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def new(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "word": new(WORD_BINS, DIM, scale=0.05), "part": new(PART_BINS, DIM, scale=0.05),
            "wx": new(2, 2 * DIM, 3 * HIDDEN, scale=0.4), "u": new(2, HIDDEN, 3 * HIDDEN, scale=0.3), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "wa": new(2 * HIDDEN, HIDDEN, scale=0.4), "va": new(HIDDEN, scale=0.4), "wo": new(2 * HIDDEN, scale=0.4), "bo": np.full(1, -2, np.float32),
        }

    def embed(self, bins: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["word"][bins[:, 0]], self.p["part"][bins[:, 1:]].sum(1)], 1)

    def projected(self, bins: np.ndarray) -> np.ndarray:
        """What each distinct word adds to the gates, of both directions: (2, words, 3 * HIDDEN)."""
        return self.embed(bins) @ self.p["wx"] + self.p["b"]

    def forward(self, x: np.ndarray, size: np.ndarray, keep: bool = False):
        """Scores before the sigmoid; x is (2, WINDOW, windows, 3 * HIDDEN), time reversed in the second."""
        p, steps, n = self.p, x.shape[1], x.shape[2]
        short = bool((size < steps).any())
        time = np.arange(steps)[:, None]
        live = np.stack([time < size, steps - 1 - time < size])[..., None].astype(np.float32) if short else None
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((2, steps, n, HIDDEN), np.float32)
        saved = []
        for t in range(steps):
            g = h @ p["u"]
            zr = _sigmoid(x[:, t, :, : 2 * HIDDEN] + g[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            m = np.tanh(x[:, t, :, 2 * HIDDEN :] + r * g[..., 2 * HIDDEN :])
            new = m + z * (h - m)
            if short:
                new = h + live[:, t] * (new - h)
            if keep:
                saved.append((h, g, z, r, m))
            h = states[:, t] = new
        both = np.concatenate([states[0], states[1, ::-1]], 2)  # (steps, windows, 2 * HIDDEN)
        a = np.tanh(both @ p["wa"])
        e = a @ p["va"]
        if short:
            e = np.where(time < size, e, np.float32(-1e9))
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * both).sum(0)
        y = pooled @ p["wo"] + p["bo"]
        return (y, (x, live, states, saved, both, a, w, pooled)) if keep else y

    def backward(self, dy: np.ndarray, kept: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the dense parameters, gradient by x)."""
        p = self.p
        x, live, states, saved, both, a, w, pooled = kept
        steps = x.shape[1]
        g = {"wo": pooled.T @ dy, "bo": dy.sum(keepdims=True)}
        d_pooled = dy[:, None] * p["wo"]
        d_both = w[..., None] * d_pooled
        d_w = (both * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["va"] = (a * d_e[..., None]).sum((0, 1))
        d_a = d_e[..., None] * p["va"] * (1 - a * a)
        g["wa"] = both.reshape(-1, 2 * HIDDEN).T @ d_a.reshape(-1, HIDDEN)
        d_both = d_both + d_a @ p["wa"].T
        d_states = np.stack([d_both[..., :HIDDEN], d_both[::-1, :, HIDDEN:]])
        dx, du = np.zeros_like(x), np.zeros_like(p["u"])
        dh = np.zeros_like(states[:, 0])
        for t in range(steps - 1, -1, -1):
            h, gate, z, r, m = saved[t]
            dh = dh + d_states[:, t]
            dn = dh * live[:, t] if live is not None else dh
            d_m = dn * (1 - z) * (1 - m * m)
            d_z = dn * (h - m) * z * (1 - z)
            d_r = d_m * gate[..., 2 * HIDDEN :] * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r, d_m * r], 2)
            dx[:, t] = np.concatenate([d_z, d_r, d_m], 2)
            du += h.transpose(0, 2, 1) @ d_gate
            dh = (dh - dn) + dn * z + d_gate @ p["u"].transpose(0, 2, 1)
        g["u"] = du
        g["b"] = dx.sum((1, 2))[:, None, :]
        return g, dx

    def score_windows(self, bins: np.ndarray, codes: np.ndarray, first: np.ndarray, size: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Scores of windows of `size` words from codes[first] on."""
        table = self.projected(bins)
        out = np.empty(len(first), np.float32)
        order = np.argsort(-size, kind="stable")  # windows that are not full come together
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            at = codes[np.minimum(first[rows] + np.arange(WINDOW)[:, None], len(codes) - 1)]
            out[rows] = self.forward(np.stack([table[0][at], table[1][at[::-1]]]), size[rows])
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bins, codes, count = inputs(data, offsets)
        row, first, size = windows(count)
        worst = np.full(len(count), -30.0)
        if len(row):
            np.maximum.at(worst, row, self.score_windows(bins, codes, (np.cumsum(count) - count)[row] + first, size))
        return np.where(count > 0, _sigmoid(np.clip(worst, -30, 30)), 0.0)

    # -- training --------------------------------------------------------------------

    def start(self, bins: np.ndarray, codes: np.ndarray, count: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Set the first inputs to smoothed log-odds; return each distinct word's own, to find first windows by."""
        total, odds = np.zeros(len(bins)), []
        size = (label == 0).sum(), (label == 1).sum()
        ends = np.cumsum(count)
        own = [np.unique(codes[b - n : b]) for b, n in zip(ends.tolist(), count.tolist(), strict=True)]
        row, code = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
        for k in range(bins.shape[1]):
            seen = np.unique(row * WORD_BINS + bins[code, k])
            there, text = seen % WORD_BINS, seen // WORD_BINS
            good, bad = (np.bincount(there[label[text] == v], minlength=WORD_BINS) for v in (0, 1))
            odds.append(((np.log(bad + 0.5) - np.log(size[1] + 1) - np.log(good + 0.5) + np.log(size[0] + 1)) * np.minimum(1, bad / 4)).clip(0, 6).astype(np.float32))
        self.p["word"][:, 0] = odds[0] / 2
        for k in range(1, bins.shape[1]):
            self.p["part"][:, 0] = np.maximum(self.p["part"][:, 0], odds[k] / 2)
        for k in range(bins.shape[1]):
            total = np.maximum(total, odds[k][bins[:, k]])
        return total

    def fit(self, distinct: np.ndarray, codes: np.ndarray, count: np.ndarray, label: np.ndarray, seed: int = SEED) -> None:
        """distinct: the input bins of each distinct word; codes: which of them each word of the texts is, in order; count: words of each text."""
        rng = np.random.default_rng(seed)
        odds = self.start(distinct, codes, count, label)
        row, first, size = windows(count)
        first = first + (np.cumsum(count) - count)[row]
        sums = np.concatenate([[0], np.cumsum(odds[codes])])
        rank = (sums[first + size] - sums[first]) / 4
        del sums
        moments: dict[str, list] = {}
        step = 0
        for turn in range(ROUNDS):
            if turn:
                rank = self.score_windows(distinct, codes, first, size)
            order = np.lexsort((-rank, row))
            worst = order[np.append(True, row[order][1:] != row[order][:-1])]
            other = rng.permutation(np.flatnonzero(label[row] == 0))[: 2 * len(worst)]
            picked = np.concatenate([worst, other])
            target = label[row[picked]].astype(np.float32)
            weight = np.where(target == 1, max(1.0, 0.5 * (target == 0).sum() / max(1, (target == 1).sum())), 1.0).astype(np.float32)
            for _ in range(EPOCHS):
                shuffled = rng.permutation(len(picked))
                for k in range(0, len(picked), BATCH):
                    rows = shuffled[k : k + BATCH]
                    step += 1
                    self._learn(distinct, codes, first[picked[rows]], size[picked[rows]], target[rows], weight[rows], moments, step)

    def _learn(self, bins, codes, first, size, target, weight, moments, step) -> None:
        p = self.p
        at = codes[np.minimum(first + np.arange(WINDOW)[:, None], len(codes) - 1)]
        own, where = np.unique(at, return_inverse=True)
        where = where.reshape(at.shape)
        e = self.embed(bins[own])
        table = e @ p["wx"] + p["b"]
        y, kept = self.forward(np.stack([table[0][where], table[1][where[::-1]]]), size, keep=True)
        g, dx = self.backward(((_sigmoid(y) - target) * weight / len(target)).astype(np.float32), kept)
        d_table = np.zeros_like(table)
        np.add.at(d_table[0], where, dx[0])
        np.add.at(d_table[1], where, dx[1][::-1])
        g["wx"] = e.T @ d_table
        d_e = (d_table @ p["wx"].transpose(0, 2, 1)).sum(0)
        for name, value in g.items():
            m = moments.setdefault(name, [np.zeros_like(p[name]), np.zeros_like(p[name])])
            m[0] += 0.1 * (value - m[0])
            m[1] += 0.01 * (value**2 - m[1])
            p[name] -= 0.01 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
        np.add.at(p["word"], bins[own, 0], -0.1 * d_e[:, :DIM])
        for k in range(1, bins.shape[1]):
            np.add.at(p["part"], bins[own, k], -0.1 * d_e[:, DIM:])


def fit(docs: DataFrame, labels: DataFrame, flag: str, learn: Column, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """The trained network, or None if a label value has no row."""

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw, offsets = c.buffers(batch.column(2))
            blobs = [packer.compress(raw[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["label", "place", "blob"])

    sample = c.labelled(docs, labels, flag, learn, rows, id_col, text_col)
    # the driver holds the sample compressed, and of its words one number each
    found = sample.mapInArrow(run, "label int, place long, blob binary").toArrow().sort_by([("place", "ascending"), ("label", "ascending")]).combine_chunks()
    label = found.column("label").to_numpy()
    if not len(label) or label.min() == label.max():
        return None
    distinct, codes, count = _numbered(found.column("blob").combine_chunks())
    network = Network()
    network.fit(distinct, codes, count, label)
    return network


def _numbered(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input bins of each distinct word, which of them each word is, words of each text) of compressed texts."""
    bins, codes, count, known = [], [], [], 0
    for k in range(0, len(blobs), FIT_TEXTS):
        texts = [zstandard.ZstdDecompressor().decompress(x.as_py()) for x in blobs[k : k + FIT_TEXTS]]
        own, code, n = inputs(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
        bins.append(own)
        codes.append((code + known).astype(np.int32))
        count.append(n)
        known += len(own)
    each = np.concatenate(bins)
    key = np.zeros(len(each), np.uint64)
    for k in range(each.shape[1]):
        key = c.mix(key + each[:, k].astype(np.uint64) + np.uint64(1))
    same, distinct = pd.factorize(key.view(np.int64))
    some = np.empty(len(distinct), np.int64)
    some[same] = np.arange(len(same))
    return each[some], same.astype(np.int32)[np.concatenate(codes)], np.concatenate(count)


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """The id as `doc_id`, the columns `keep` by name, and the score, as column `out`, of each row."""
    spread = docs.sparkSession.sparkContext.broadcast(network)
    names = [id_col, *keep]

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for batch in batches:
            for lo, hi, data, offsets in c.blocks(batch.column(len(names))):
                found = own.score(data, offsets) if own else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([*(x[lo:hi] for x in batch.columns[: len(names)]), pa.array(found, pa.float64())], [*(f"c{k}" for k in range(len(names))), "score"])

    rows = c.small_batches(docs).select(*(F.col(x).alias(f"c{k}") for k, x in enumerate(names)), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = ", ".join(f"c{k} {kind}" for k, (_, kind) in enumerate(docs.select(*names).dtypes))
    return rows.mapInArrow(run, f"{schema}, score double").select(*(F.col(f"c{k}").alias(x if k else "doc_id") for k, x in enumerate(names)), F.col("score").alias(out))
