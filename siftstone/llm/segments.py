"""Encoding of each distinct stretch of text once.

Tokenizers split text at white space, so the stretches between are encoded by themselves. A
block's equal stretches are found by hash (BLAKE2b where they are long); what the worker has met
before is looked up by its bytes, and only the rest goes through the tokenizer.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd

from . import common as c

#: Stretches that a generation of the cache holds; the cache keeps two.
CACHE_ENTRIES = 250_000


class Cache:
    """Bytes of a stretch -> its ids; when a generation is full, the one before it is dropped. Long stretches are not kept."""

    def __init__(self, encode: Callable[[str], list[int]], entries: int = CACHE_ENTRIES):
        self.encode, self.entries = encode, entries
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many for each stretch)."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        codes, distinct = pd.factorize(c.stretch_hash(data, start, end))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        raw, young, old, encode = data.tobytes(), self.young, self.old, self.encode
        keys = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        parts = list(map(young.get, keys))
        for k, part in enumerate(parts):
            if part is None:
                key = keys[k]
                part = old.get(key)
                if part is None:
                    part = array("I", encode(key.decode("utf-8", "surrogatepass"))).tobytes()
                parts[k] = part
                if len(key) <= c.SHORT_BYTES:
                    young[key] = part
        if len(young) > self.entries:
            self.old, self.young = young, {}
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.uint32)
        count = size[codes]
        return flat[c.ranges((np.cumsum(size) - size)[codes], count)], count
