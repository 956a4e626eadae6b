"""Byte-level BPE by a rank file: encoding with offsets, and decoding.

The ranks become a BPE model of the tokenizers library: bytes are written as characters by
the usual byte table, and every split of a token into two known tokens is a merge at that
token's rank, which is how tiktoken merges. Each match of the pattern is encoded by itself.

Rows: null text is empty and has no ids; ids are as many as the text needs, never cut. Decoding
joins the tokens' bytes; a character split over tokens comes back when its tokens stand
together, and bytes that are no UTF-8 become U+FFFD in `text` (never in `bytes`). Unknown or
null ids decode to nothing. The results carry the id column and their own columns only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .segments import Cache

#: Fixed: Unicode's white space, as the pattern's \s means it.
SPACES = "\t-\r \x85\xa0{}{}-{}{}{}{}{}{}".format(*map(chr, (0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WIDE_SPACE = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Codec:
    def __init__(self, path: str, pattern: str):
        from tokenizers.models import BPE

        ranks = read_ranks(path)
        names = byte_characters()
        self.table = {b: names[b] for b in range(256)}
        written = {t: "".join(map(names.__getitem__, t)) for t in ranks}
        merges = [(written[t[:k]], written[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.model = BPE({written[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")).findall
        self.latin = [names[b] for b in range(256)]
        self.cache = Cache(self.encode)
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, text: str) -> list[int]:
        tokenize, table = self.model.tokenize, self.table
        return [t.id for piece in self.pieces(text) for t in tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(table))]

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets into them) of each row."""
        start, end, row = stretches(data, offsets)
        ids, count = self.cache.ids(data, start, end)
        per_row = np.bincount(row, count, len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])

    def token_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens, size of each)."""
        known = (ids >= 0) & (ids < len(self.sizes))
        at = np.where(known, ids, 0)
        size = np.where(known, self.sizes[at], 0) if len(self.sizes) else np.zeros(len(ids), np.int64)
        return self.bytes[c.ranges(self.starts[at], size)], size


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that the pattern never joins: words with a space before, and white space between.

    Of white space before a word the last character stands apart, by itself or, if it is a
    space, with the word. A row with white space outside ASCII is one stretch.
    """
    start, end, row = c.words(data, offsets)
    led = np.zeros(len(start), bool)
    inner = start > offsets[row]
    led[inner] = data[start[inner] - 1] == 0x20
    head = start - led
    # gaps before words (and after the last): from the end of what comes before, in its row
    before = np.concatenate([[0], end[:-1]]) if len(end) else end
    new_row = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    before = np.where(new_row, offsets[row], before)
    alone = ~led & (head - before >= 2)
    split = np.where(alone, head - 1, head)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    tail_from = offsets[:-1].copy()
    tail_from[row[last]] = end[last]
    rows = np.arange(len(offsets) - 1)
    a = np.concatenate([before, split, head, tail_from])
    b = np.concatenate([split, np.where(alone, head, split), end, offsets[1:]])
    r = np.concatenate([row, row, row, rows])
    keep = b > a
    a, b, r = a[keep], b[keep], r[keep]
    odd = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in WIDE_SPACE.finditer(data.tobytes())}
    if odd:
        odd = np.array(sorted(odd))
        keep = ~np.isin(r, odd)
        a, b, r = (np.concatenate(x) for x in ((a[keep], offsets[odd]), (b[keep], offsets[odd + 1]), (r[keep], odd)))
    order = np.argsort(a, kind="stable")
    return a[order], b[order], r[order]


def codec(path: str, pattern: str) -> Codec:
    return c.kept(("byte_bpe", path, pattern), lambda: Codec(path, pattern))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).dtypes[0][1]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, char_ends array<int>: a token's end in code points; one that ends
    inside a character ends before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for lo, hi, data, offsets in c.blocks(batch.column(1), 1 << 20):
                ids, ends = own.encode_rows(data, offsets)
                _, size = own.token_bytes(ids.astype(np.int64))
                whole = np.append((data & 0xC0) != 0x80, True)  # a character begins here
                chars = np.concatenate([[0], np.cumsum(whole[:-1])])
                at = np.cumsum(size)
                row = np.repeat(np.arange(hi - lo), np.diff(ends))
                stop = chars[at] - ~whole[at] - chars[offsets[row]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], _lists(ids, ends), _lists(stop, ends)], ["doc_id", "ids", "char_ends"])

    return _text(docs, id_col, text_col).mapInArrow(run, f"doc_id {_id_type(docs, id_col)}, ids array<int>, char_ends array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes binary, text string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raws = [own.token_bytes(np.array([-1 if i is None else i for i in ids or ()], np.int64))[0].tobytes() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raws], pa.string())], ["doc_id", "bytes", "text"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {_id_type(tokens, id_col)}, bytes binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() of each row in one pass, as counts and SHA-256 digests."""

    @c.tidy_keeping
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Callable[[str, str], Codec] = codec(path, pattern)
        for batch in batches:
            for lo, hi, data, offsets in c.blocks(batch.column(1), 1 << 20):
                ids, ends = own.encode_rows(data, offsets)
                raw, size = own.token_bytes(ids.astype(np.int64))
                at = np.concatenate([[0], np.cumsum(size)])[ends]
                words, text = ids.astype("<u4").tobytes(), raw.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        pa.array(np.diff(ends)),
                        pa.array([hashlib.sha256(words[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]),
                        pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _text(docs, id_col, text_col).mapInArrow(run, f"doc_id {_id_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
