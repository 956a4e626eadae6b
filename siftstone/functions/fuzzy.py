"""The normalised InDel ratio, which Spark has no function for, as an Arrow UDF and over arrays inside a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine of one big integer."""
    masks: dict[str, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    state = full
    for y in b:
        u = state & masks.get(y, 0)
        state = ((state + u) | (state - u)) & full
    return len(a) - bin(state).count("1")


#: Bits of a word of the machine below, whose last bit is the carry, and characters that it reads at once.
BITS, AT_ONCE = 63, 1 << 22


def lcs_lengths(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The same of one text with many, all as code points: the big integers of all of them in words, each word a character behind the one before it, which hands on its carry."""
    known, place = np.unique(a, return_inverse=True)
    words, at = -(-len(a) // BITS), np.arange(len(a))
    masks = np.zeros((words, len(known) + 1), np.uint64)
    np.bitwise_or.at(masks, (words - 1 - at // BITS, place), np.uint64(1) << (at % BITS).astype(np.uint64))
    masks, first, full, carried = masks.ravel(), (np.arange(words) * (len(known) + 1))[:, None], np.uint64((1 << BITS) - 1), np.uint64(BITS)
    found = np.empty(len(others), np.int64)
    longest = max(map(len, others), default=0) + 2 * words
    for start in range(0, len(others), max(1, AT_ONCE // longest)):
        some = others[start : start + max(1, AT_ONCE // longest)]
        read = np.full((max(map(len, some)) + 2 * words - 2, len(some)), len(known))
        for k, b in enumerate(some):
            x = np.minimum(np.searchsorted(known, b), len(known) - 1)
            read[words - 1 : words - 1 + len(b), k] = np.where(known[x] == b, x, len(known))
        state, carry = np.full((words, len(some)), full), np.zeros((words, len(some)), np.uint64)
        for t in range(len(read) - words + 1):
            u = state & masks[read[t : t + words] + first]
            total = state + u + carry
            carry[:-1] = total[1:] >> carried
            state = (total | (state ^ u)) & full
        found[start : start + len(some)] = words * BITS - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
    return found


def ratio_of(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (both lengths); 100 for two empty texts."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio_of(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def windows(text: Column, size: Column) -> Column:
    """The stretches of a text that a quote of `size` characters is compared with: from every twentieth of the text on, once,
    twice and three times as long, cut at the text's end."""
    step = F.greatest(F.lit(1), F.floor(F.length(text) / 20).cast("int"))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), step)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda at: F.array(*(F.substring(text, at, size * k) for k in (1, 2, 3)))))


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths allow a ratio of `least`; used before the ratio itself."""
    return 200 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))
