"""Packing into sequences by power-of-two decomposition.

A document of n ids (its end id included) is cut into whole sequences of LIMIT ids and then
into one piece for each 1 in the binary writing of the rest, longest first. Every piece is a
sequence of its own whose length is a power of two, so no sequence crosses documents and
none needs padding; batches are drawn from the buckets of equal `length`. Nothing is shuffled.

Rows: null or empty text has the end id alone; repeated rows and repeated ids are packed each
by itself. Ids are of any type. Texts are packed whole however long they are, an empty table has no
pieces, and extra columns are not looked at. sequence_id is Spark's monotonically_increasing_id of the pieces,
so it is unique in the result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .byte_bpe import byte_characters
from .segments import Cache

LIMIT = 4096
END_ID = 2
PLAIN = regex.compile(r"[!-~\u00a1-\u024f]+").fullmatch


class Encoder:
    """A tokenizers file of a lower-casing BPE with word ends; a piece of plain text is cut by
    the file's own pattern and goes to its model, all other text through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        lower = any(x["type"] == "Lowercase" for x in spec["normalizer"]["normalizers"])
        self.simple = lower and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall if self.simple else None
        self.table = dict(enumerate(byte_characters()))
        self.model = self.whole.model
        self.words: dict[str, list[int]] = {}
        self.cache = Cache(self.encode)

    def encode(self, text: str) -> list[int]:
        if not (self.simple and (text.isascii() and text.isprintable() or PLAIN(text))):
            return self.whole.encode(text, add_special_tokens=False).ids
        out, words = [], self.words
        for piece in self.pieces(text.lower()):
            ids = words.get(piece)
            if ids is None:
                if len(words) > self.cache.entries:
                    words.clear()
                ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]
                if len(piece) <= c.SHORT_BYTES:
                    words[piece] = ids
            out += ids
        return out

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        start, end, row = c.words(data, offsets)
        ids, count = self.cache.ids(data, start, end)
        n = len(offsets) - 1
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, count, n).astype(np.int64))])
        return np.insert(ids, ends[1:], end_id), ends + np.arange(n + 1)


def encoder(path: str) -> Encoder:
    return c.kept(("packing", path), lambda: Encoder(path))


def cuts(n: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of the pieces of rows with n ids each; limit is a power of two."""
    whole, rest = n // limit, n % limit
    bits = limit >> np.arange(1, max(2, limit.bit_length()))
    has = (rest[:, None] & bits[None, :]) > 0
    count = whole + has.sum(1)
    row = np.repeat(np.arange(len(n)), count)
    length = np.full(len(row), limit, np.int64)
    order = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    length[order >= whole[row]] = np.broadcast_to(bits, has.shape)[has]
    sums = np.cumsum(length) - length
    return row, sums - np.repeat(sums[np.cumsum(count) - count], count) if len(row) else sums, length


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids` on request."""
    if limit < 1 or limit & (limit - 1):
        raise ValueError("the limit must be a power of two")

    @c.tidy_keeping
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in c.blocks(batch.column(1), 1 << 20):
                ids, ends = own.encode_rows(data, offsets, end_id)
                row, start, length = cuts(np.diff(ends), limit)
                raw = ids.astype("<u4").tobytes()
                at = ends[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0)[lo:hi].take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.diff(ends)[row])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = c.small_batches(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.select(id_col).dtypes[0][1]
    pieces = rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else ""))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return pieces.select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
