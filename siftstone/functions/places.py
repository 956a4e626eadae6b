"""Normal forms of quotes that know where each of their characters stood in the source."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ELLIPSES

#: The marks that normal_quote takes off, in its order.
MARKS = [re.compile(x) for x in (r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*", r"_([^_]+)_", r"`([^`]+)`")]
SHOWN, PREVIEW = 100, 500


def _keep(text: str, places: np.ndarray, parts: list[tuple[int, int]]) -> tuple[str, np.ndarray]:
    return "".join(text[a:b] for a, b in parts), np.concatenate([places[a:b] for a, b in parts]) if parts else places[:0]


def _without(text: str, places: np.ndarray, gone: list[tuple[int, int]]) -> tuple[str, np.ndarray]:
    """Drops stretches, given in order."""
    if not gone:
        return text, places
    edges = [0, *(x for span in gone for x in span), len(text)]
    return _keep(text, places, list(zip(edges[::2], edges[1::2], strict=True)))


def normal(text: str) -> tuple[str, np.ndarray]:
    """The form of text.normal_quote and, of each of its characters, the place in the source."""
    places = np.arange(len(text))
    for mark in MARKS:
        gone = [x for m in mark.finditer(text) for x in ((m.start(), m.start(1)), (m.end(1), m.end()))]
        text, places = _without(text, places, gone)
    for dots in ELLIPSES:
        text, places = _without(text, places, [m.span() for m in re.finditer(re.escape(dots), text)])
    low = text.lower()
    if len(low) != len(text):
        places = np.repeat(places, [len(x.lower()) for x in text])
    # of a run of white space the first place stays
    text, places = _without(low, places, [(m.start() + 1, m.end()) for m in re.finditer(r"\s+", low) if m.end() - m.start() > 1])
    text = re.sub(r"\s", " ", text)
    lead = len(text) - len(text.lstrip(" "))
    end = len(text.rstrip(" "))
    return text[lead:end], places[lead:end]


def span(quote: str, text: str, form: tuple[str, np.ndarray] | None = None) -> tuple[int, int] | None:
    """Where the text first has the quote, which is in normal form: the leftmost stretch, and the shortest from there, whose own normal form it is.

    The map gives the stretch from the first to the last character; beyond it only what has no
    character of its own in the normal form, or is white space around it, may be part of it. A stretch of more than three times the quote's
    length gives way to a later one; if there is none, or marks reach beyond every stretch, the first counts from its first to its last character.
    """
    whole, places = form or normal(text)
    at = first = whole.find(quote) if quote else -1
    most = 3 * len(quote)
    while at >= 0:
        last = at + len(quote) - 1
        start, end = int(places[at]), int(places[last]) + 1
        before = at - 2 if at and whole[at - 1] == " " else at - 1
        low = int(places[before]) + 1 if before >= 0 else 0
        high = int(places[last + 1]) if last + 1 < len(places) else len(text)
        for s in range(max(low, end - most), start + 1):
            for e in range(end, min(high, s + most) + 1):
                if normal(text[s:e])[0] == quote:
                    return s, e
        at = whole.find(quote, at + 1)
    return (int(places[first]), int(places[first + len(quote) - 1]) + 1) if first >= 0 else None


def spans(quote: Column, text: Column) -> Column:
    """(start, end, shown) of the quote in normal form in the text, from 0, and what is shown: the stretch and SHOWN characters more; null where it is not there."""

    @F.pandas_udf("struct<start: long, end: long, shown: string>")
    def run(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out, forms = [], {}
        for q, t in zip(quotes, texts, strict=True):
            if q is None or t is None:
                out.append((None, None, None))
                continue
            if t not in forms:
                forms = {t: normal(t)}
            found = span(q, t, forms[t])
            out.append((None, None, None) if found is None else (*found, t[found[0] : found[1] + SHOWN]))
        return pd.DataFrame(out, columns=["start", "end", "shown"]).astype({"start": "Int64", "end": "Int64"})

    return run(quote, text)
