"""Language identification by rank-order profiles.

A profile is a list of the TOP most frequent 1- to 3-grams of letters, words being padded with
a blank on either side, by falling count and then by the n-gram. A language's profile counts all
its training texts; a document is compared by the out-of-place distance: the sum over its own
ranked n-grams of how far each stands from its rank in the language, TOP for one that is absent.
The nearest language wins, ties going to the smaller name; the score is one minus the distance
over its largest value, so 1 is a document ranked just as the language.

Rows: a null text or one without letters is `und` with score 0. Training rows with a null text or
language are passed over. Without training rows every document is `und`. Texts are lower-cased
and read whole; long ones are counted in pieces that end at a blank. Repeated rows get equal results, an
empty table gives an empty result, and extra columns are kept on request and never looked at.
More than MAX_LANGUAGES languages raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

TOP = 300
#: Profiles are collected: at most so many languages, so the bound is MAX_LANGUAGES * TOP n-grams.
MAX_LANGUAGES = 2000
UNKNOWN = "und"
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Codes of the 1- to 3-grams of a text: three code points of 21 bits; runs of other characters are one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate([[0], points, [0]])
    keep = points > 0
    keep[1:] |= points[:-1] > 0
    keep[0] = True
    points = points[keep]  # blanks stand single: one after each word, and one at the start
    if len(points) < 2:
        return np.zeros(0, np.int64)
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    # marks in the top bits keep the orders apart
    one = points[points > 0]
    return np.concatenate([one, two | (1 << 42), three[(three >> 21) & 0x1FFFFF != 0] | (1 << 62) if len(three) else three])


def _count(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, counts), sorted by n-gram."""
    codes = counts = np.zeros(0, np.int64)
    for at in _cuts(text):
        part = np.sort(_codes(text[at[0] : at[1]]))
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        own, n = part[cut], np.diff(np.append(cut, len(part)))
        if len(codes):
            merged, where = np.unique(np.concatenate([codes, own]), return_inverse=True)
            codes, counts = merged, np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
        else:
            codes, counts = own, n
    return codes, counts


def _cuts(text: str) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE characters that end at a blank, the next one if there is none within."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + PIECE < end:
            found = text.rfind(" ", at + 1, at + PIECE)
            found = found if found > 0 else text.find(" ", at + PIECE)
            end = found if found > 0 else end
        yield at, end
        at = end


def _ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, by falling count and then by n-gram."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


def profiles(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """The ranked n-grams of each language, over all rows where `training` holds."""

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out = []
            for lang, (codes, counts) in held.items():
                merged, where = np.unique(np.concatenate(codes), return_inverse=True)
                out.append((lang, merged, np.bincount(where, np.concatenate(counts)).astype(np.int64)))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.string()), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))],
                ["lang", "gram", "n"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = _count(text.as_py())
                own = held.setdefault(lang, ([], []))
                own[0].append(codes)
                own[1].append(counts)
                size += len(codes)
                if size > 2_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    found = best.limit(MAX_LANGUAGES * top + 1).collect()
    if len(found) > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, list[int]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Ranks:
    """Ranks of the profiles' n-grams in each language."""

    def __init__(self, known: dict[str, list[int]], top: int):
        self.names = sorted(known)
        self.grams = np.unique(np.array([g for x in known.values() for g in x], np.int64))
        self.rank = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.grams, np.array(known[name], np.int64)), k] = np.arange(len(known[name]))
        self.top = top

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes, counts = _count(text or "")
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = _ranked(codes, counts, self.top)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        rank = self.rank[at]
        far = np.where(rank < 0, self.top, np.abs(rank - np.arange(len(own))[:, None])).sum(0)
        k = int(np.argmin(far))
        return self.names[k], 1.0 - float(far[k]) / (self.top * len(own))


def identify(docs: DataFrame, known: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), top: int = TOP, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The id as `doc_id`, the columns `keep` by name, and the language and score, as columns `out`, of each row."""
    ranks = docs.sparkSession.sparkContext.broadcast(known)
    names = [id_col, *keep]

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ranks(ranks.value, top)
        for batch in batches:
            found = [own.nearest(x.as_py()) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*(f"c{k}" for k in range(len(names))), "lang_pred", "score"])

    rows = docs.select(*(F.col(x).alias(f"c{k}") for k, x in enumerate(names)), F.col(text_col).alias("t"))
    schema = ", ".join(f"c{k} {kind}" for k, (_, kind) in enumerate(docs.select(*names).dtypes))
    found = rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return found.select(*(F.col(f"c{k}").alias(x if k else "doc_id") for k, x in enumerate(names)), F.col("lang_pred").alias(out[0]), F.col("score").alias(out[1]))
