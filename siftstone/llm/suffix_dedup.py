"""Removal of repeated passages by prefix-free parsing.

Parse. A rolling hash of WIDTH bytes runs over the text; the least hash among the grams of
a window of `length` bytes is its trigger, so equal windows have equal triggers wherever
they stand. A phrase is a maximal run of windows with one trigger, and overlaps the next
phrase by length - 1 bytes: every window of the corpus lies in exactly one phrase.
A trigger with HEAVY_BYTES windows or more in the corpus (they are counted first) is told
apart by what stands around it: of its windows those that begin near it are keyed by the 29
bytes from its start on, the others by the 30 bytes up to its end; where that key is as heavy
again, each window is keyed by the whole of its bytes. All keys depend on a window's own bytes
alone, so equal windows have equal keys.
Dictionary. Phrases are dealt to ranges by their key. Equal phrases are kept once, with
the smallest document that has them; the others are repeats as a whole. A task merges its own
equal phrases before it sends them, and a range merges those of all tasks.
Suffix array. Within a range the suffixes of the dictionary's phrases that have a whole window
are put in lexicographic order to the depth `length`: by their first eight bytes, then, as long
as suffixes tie and are not alike to that depth (told by hash, and compared once), by the next five. Each window lies in one phrase,
so this depth never passes a phrase's end, and the order of the parse (which phrase follows
which) decides nothing; what the parse adds is in which documents a phrase stands. Read along the
suffix array, a run of suffixes that have `length` bytes in common, with the documents of their
phrases, is the list of a passage's places in corpus order: its smallest document keeps its bytes,
the others mark theirs.

Only phrases (about three bytes for each byte of input, packed), marks and counts are shuffled.
Marks of one document that touch are joined where they are made, in the task that parses and in
the range, and go packed to the bucket of their document, where the marks of all ranges are joined. A range holds about RANGE_BYTES windows
in the mean, and besides them those of its largest key: under HEAVY_BYTES, or windows that are
equal. Those must meet, but of equal phrases in a task's flush of FLUSH_BYTES only one is sent.

Rows: null text is empty; rows with a null id are returned as they are and mark nothing;
rows of one id (repeats too) never mark each other. Ids that are no whole numbers are an error. Texts under `length` bytes stay whole. A very
long text is parsed in pieces, whose windows are those of the whole. Other columns play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LENGTH = 50
WIDTH = 8
RANGE_BYTES = 2_000_000
HEAVY_BYTES = 2 * RANGE_BYTES
#: From this many times HEAVY_BYTES on a key is heavy only with its share of the corpus, so the driver's list does not grow further.
HEAVY_KEYS = 4_000_000
FLUSH_BYTES = 32 << 20
#: Text whose marks meet in one bucket, in the mean.
BUCKET_BYTES = 16_000_000
U64 = np.uint64


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    out, n = values, 1
    while n * 2 <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[: len(out) - (width - n)], out[width - n :]) if width > n else out


def _segments(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row numbers, bytes, offsets, first byte's place in its row); a long text comes in overlapping parts."""
    for lo, hi, data, offsets in c.blocks(column):
        if hi - lo > 1 or len(data) <= 2 * c.BLOCK_BYTES:
            yield np.arange(lo, hi), data, offsets, 0
        else:
            for at in range(0, max(1, len(data) - length + 1), c.BLOCK_BYTES):
                part = data[at : at + c.BLOCK_BYTES + length - 1]
                yield np.array([lo]), part, np.array([0, len(part)]), at


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the known ones, which ascend."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _around(gram: np.ndarray, sums: np.ndarray, window: np.ndarray, length: int) -> np.ndarray:
    """A key of each of these windows by its trigger and the bytes behind or before it, whichever are more."""
    places = (gram.astype(U64) << U64(32)) | np.arange(len(gram), dtype=U64)
    at = (_window_min(places, length - WIDTH + 1)[window] & U64(0xFFFFFFFF)).astype(np.int64)
    half = (length - WIDTH) // 2
    early = at - window <= half
    start = np.where(early, at, at - half - 1)
    return c.mix(c.span_hash(sums, start, np.where(early, at + length - half, at + WIDTH)) + early)


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, heavy: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, row, content hash) of each phrase of these rows; `heavy` has ascending triggers and keys around them."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (U64, np.int64, np.int64, np.int64, U64))
    sums = c.prefix_sums(data)
    at = np.arange(n - WIDTH + 1)
    gram = (c.mix(c.span_hash(sums, at, at + WIDTH)) >> U64(32)).astype(np.uint32)
    least = _window_min(gram, length - WIDTH + 1)
    room = offsets[1:] - offsets[:-1]
    valid = np.zeros(len(least) + 1, np.int32)
    long = room >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, (offsets[1:] - length + 1)[long], -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[offsets[:-1][long]] = True
    key = least.astype(U64)

    def runs() -> tuple[np.ndarray, np.ndarray]:
        first, stop = np.flatnonzero(new), np.flatnonzero(new | ~valid)
        return first, np.append(stop, len(least))[np.searchsorted(stop, first, "right")]

    first, end = runs()
    if heavy:
        near = _among(least[first], heavy[0])
        if near.any():
            window = c.ranges(first[near], (end - first)[near])
            key[window] = _around(gram, sums, window, length)
            deep = window[_among(key[window], heavy[1])]
            key[deep] = c.mix(c.span_hash(sums, deep, deep + length))
            window = window[window > 0]
            new[window] |= key[window] != key[window - 1]
            first, end = runs()
    row = np.searchsorted(offsets, first, "right") - 1
    return key[first], first, end - first, row, c.span_hash(sums, first, end + length - 1)


def _pack(parts: list[tuple[np.ndarray, ...]]) -> bytes:
    doc, tag, start, run, raw = (np.concatenate(x) for x in [*zip(*parts, strict=True)][:5])
    head = struct.pack("<IB", len(doc), bool(tag.any()))
    body = [np.diff(doc, prepend=0).astype("<i8"), *([tag.astype("<i8")] if tag.any() else []), start.astype("<u4"), run.astype("<u4"), raw]
    # the high bytes of sorted numbers are alike: stored byte by byte they compress well
    planes = [x.view(np.uint8).reshape(len(doc), -1).T.tobytes() if x is not raw else raw.tobytes() for x in body]
    return zstandard.ZstdCompressor(level=5).compress(head + b"".join(planes))


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n, tagged), at = struct.unpack_from("<IB", raw), 5
    out = []
    for kind, size, there in (("<i8", 8, True), ("<i8", 8, tagged), ("<u4", 4, True), ("<u4", 4, True)):
        if not there:
            out.append(np.zeros(n, np.int64))
            continue
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel())
        at += n * size
    return np.cumsum(out[0]), out[1], out[2].astype(np.int64), out[3].astype(np.int64), np.frombuffer(raw, np.uint8, offset=at)


def _union(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """These spans with those of one document that overlap or touch joined, by document and start."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = (x[order] for x in (doc, tag, start, end))
    text = np.cumsum((np.diff(doc, prepend=0) != 0) | (np.diff(tag, prepend=0) != 0)) << 32
    reach = np.maximum.accumulate(text + end)
    at = np.flatnonzero(np.append(True, (text + start)[1:] > reach[:-1])[: len(doc)])
    return doc[at], tag[at], start[at], (reach - text)[np.append(at[1:], len(doc)) - 1] if len(at) else end


def _dealt(marks: list[tuple[np.ndarray, ...]], n_buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, packed marks) of the union of these marks: documents, tags, starts and ends."""
    if not marks:
        return []
    doc, tag, start, end = _union(*(np.concatenate(x) for x in zip(*marks, strict=True)))
    place = (c.mix(doc.astype(U64)) % U64(n_buckets)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
    return [(int(place[p[0]]), c.pack(doc[p], tag[p], start[p], (end - start)[p])) for p in np.split(order, cuts[1:]) if len(p)]


def _marked(blob: bytes) -> tuple[np.ndarray, ...]:
    doc, tag, start, size = (x.view(np.int64) for x in c.unpack(blob))
    return doc, tag, start, start + size


SENT = pa.schema([("bin", pa.int64()), ("marks", pa.bool_()), ("blob", pa.binary())])


def _count(total: int, least: int, length: int, heavy: tuple[np.ndarray, np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, n): windows of each trigger, or of each key around the heavy ones, but for keys that are rare in a part."""

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            if not held:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["key", "n"])
            key, run = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, run).astype(np.int64)
            # what is left out adds up to no more than least / 2 windows of a trigger
            many = n >= size * (least / 2) / total
            return pa.RecordBatch.from_arrays([pa.array(key[many].astype(np.int64)), pa.array(n[many])], ["key", "n"])

        for batch in batches:
            for _, data, offsets, _ in _segments(batch.column(0), length):
                key, _, run, _, _ = phrases(data, offsets, length, heavy)
                size += int(run.sum())
                if heavy:  # keys of triggers have 32 bits
                    key, run = key[key >> U64(32) > 0], run[key >> U64(32) > 0]
                if not len(key):
                    continue
                held.append((key, run))
                if size > FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def heavy_keys(texts: DataFrame, total: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """All triggers, and all keys around these, with HEAVY_BYTES windows or more, or total / HEAVY_KEYS if that is more.

    There are at most 2 * HEAVY_KEYS of each (12 bytes of both), whatever the corpus. Keys decide where windows meet, not which.
    """
    least = max(HEAVY_BYTES, total // HEAVY_KEYS)

    def find(heavy: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        counts = texts.mapInArrow(_count(total, least, length, heavy), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return np.sort(counts.where(F.col("n") >= least / 2).select("key").toArrow().column(0).to_numpy().astype(U64))

    none = np.zeros(0, U64)
    triggers = find(None).astype(np.uint32) if total >= least else none
    return triggers, find((triggers, none)) if len(triggers) else none


def _parse(n_ranges: int, n_buckets: int, length: int, heavy: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        marks: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sent = []
            for place in sorted(held):
                once, (doc, tag, start, run) = _merge(held.pop(place), length)
                marks.append((doc, tag, start, start + run + length - 1))
                sent.append((place, False, _pack(once)))
            sent += [(place, True, blob) for place, blob in _dealt(marks, n_buckets)]
            marks.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*sent, strict=True), SENT.types, strict=True)], schema=SENT)

        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for rows, data, offsets, base in _segments(batch.column(2), length):
                key, first, run, row, content = phrases(data, offsets, length, heavy)
                if not len(key):
                    continue
                doc = ids[rows[row]]
                order = np.lexsort((doc, content))
                fresh = np.ones(len(order), bool)
                fresh[1:] = content[order][1:] != content[order][:-1]
                group = np.cumsum(fresh) - 1
                owner = np.empty(len(order), np.int64)
                owner[order] = doc[order][fresh][group]
                same = np.empty(len(order), np.int64)
                same[order] = order[fresh][group]
                later = doc > owner
                later[later] = _equal(data, first[later], first[same[later]], run[later] + length - 1, run[same[later]] + length - 1)
                begin = first - offsets[row] + base
                tag = tags[rows[row]]
                marks.append((doc[later], tag[later], begin[later], (begin + run)[later] + length - 1))
                size += 24 * int(later.sum())
                place = (c.mix(key) % U64(n_ranges)).astype(np.int64)
                picked = np.flatnonzero(~later)
                picked = picked[np.argsort(place[picked], kind="stable")]
                cuts = np.flatnonzero(np.diff(place[picked], prepend=-1))
                for p in np.split(picked, cuts[1:]):
                    raw = data[c.ranges(first[p], run[p] + length - 1)]
                    held.setdefault(int(place[p[0]]), []).append((doc[p], tag[p], begin[p], run[p], raw, content[p]))
                    size += len(raw) + 24 * len(p)
                if size > FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _merge(parts: list[tuple[np.ndarray, ...]], length: int) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]:
    """(phrases once each, with their smallest document; the places of the others)."""
    doc, tag, start, run, data, content = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = run + length - 1
    at = np.cumsum(size) - size
    whole = _copies(data, doc, at, size, content)
    kept = ~whole
    once = doc[kept], tag[kept], start[kept], run[kept], data[np.repeat(kept, size)], content[kept]
    return [once], (doc[whole], tag[whole], start[whole], run[whole])


def _copies(data: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same phrase; bytes are compared where the hashes `content` are equal."""
    order = np.lexsort((doc, content))
    fresh = np.ones(len(order), bool)
    fresh[1:] = content[order][1:] != content[order][:-1]
    head = np.empty(len(order), np.int64)
    head[order] = order[fresh][np.cumsum(fresh) - 1]
    whole = doc > doc[head]
    whole[whole] = _equal(data, at[whole], at[head[whole]], size[whole], size[head[whole]])
    return whole


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether data[a:a+na] equals data[b:b+nb], for each pair."""
    out = na == nb
    if out.any():
        a, b, n = a[out], b[out], na[out]
        bad = data[c.ranges(a, n)] != data[c.ranges(b, n)]
        out[out] = np.add.reduceat(bad, np.cumsum(n) - n) == 0
    return out


def _order(n_buckets: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, marks = [], []
        for batch in batches:
            for known, blob in zip(batch.column("marks").to_pylist(), batch.column("blob"), strict=True):
                if known:
                    marks.append(_marked(blob.as_py()))
                else:
                    parts.append(_unpack(blob.as_py()))
        if parts:
            whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
            parts.clear()
            marks += repeats(*whole, length)
        for place, blob in _dealt(marks, n_buckets):
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "blob"])

    return run


@c.tidy
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tag, spans) of each document of a bucket."""
    marks = [_marked(blob.as_py()) for batch in batches for blob in batch.column("blob")]
    doc, tag, start, end = _union(*(np.concatenate(x) for x in zip(*marks, strict=True)))
    at = np.flatnonzero((np.diff(doc, prepend=doc[:1] - 1) != 0) | (np.diff(tag, prepend=0) != 0))
    spans = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), pa.array((start << 32) | end, pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at]), spans], ["doc", "tag", "spans"])


def repeats(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, run: np.ndarray, data: np.ndarray, length: int) -> list[tuple[np.ndarray, ...]]:
    """Marks (documents, tags, starts, ends) of the windows that a smaller document has too, among the phrases of one range."""
    size = run + length - 1
    at = np.cumsum(size) - size
    # the dictionary: equal phrases once, with their smallest document
    content = np.empty(len(doc), U64)
    for lo, hi, base, sums in _parts(data, at, size):
        content[lo:hi] = c.span_hash(sums, at[lo:hi] - base, (at + size)[lo:hi] - base)
    whole = _copies(data, doc, at, size, content)
    out = [(doc[whole], tag[whole], start[whole], (start + size)[whole])]
    kept = np.flatnonzero(~whole)
    # the suffixes of its phrases that have a whole window
    narrow = np.int32 if len(data) < 1 << 31 else np.int64
    window = np.repeat((at[kept] - (np.cumsum(run[kept]) - run[kept])).astype(narrow), run[kept])
    window += np.arange(len(window), dtype=narrow)
    owner = np.repeat(kept.astype(np.int32), run[kept])
    value, done = np.empty(len(window), U64), 0
    for lo, hi, base, sums in _parts(data, at, size):
        own = lo + np.flatnonzero(~whole[lo:hi])
        here = c.ranges(at[own] - base, run[own])
        value[done : done + len(here)] = c.span_hash(sums, here, here + length)
        done += len(here)
    order, fresh = suffix_array(data, window, length, value)
    del value
    # windows of their own decide nothing
    slot = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
    if len(slot):
        order = order[slot]
        who = doc[owner[order]]
        cut = np.flatnonzero(fresh[slot])
        later = who > np.repeat(np.minimum.reduceat(who, cut), np.diff(np.append(cut, len(who))))
        flag = np.zeros(len(window), bool)
        flag[order[later]] = True
        edge = np.append(True, owner[1:] != owner[:-1])
        b = np.flatnonzero(flag & (edge | ~np.append(False, flag[:-1])))
        e = np.flatnonzero(flag & (np.append(edge[1:], True) | ~np.append(flag[1:], False)))
        o = owner[b]
        out.append((doc[o], tag[o], start[o] + window[b] - at[o], start[o] + window[e] - at[o] + length))
    return out


def suffix_array(data: np.ndarray, window: np.ndarray, length: int, value: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes that begin at `window` by their first `length` bytes; whether each differs there from the one before).

    `value` has hashes of these bytes: ties of one hash are not ordered any further, but compared once.
    """
    if not len(window):
        return np.zeros(0, window.dtype), np.zeros(0, bool)
    eight = np.ndarray((len(data) + 1,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    depth = min(8, length)
    key = eight[window].byteswap(inplace=True).view(U64)
    key >>= U64(64 - 8 * depth)
    order = np.argsort(key).astype(window.dtype)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    del key
    slot = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
    while depth < length and len(slot):
        if value is not None:
            own = value[order[slot]]
            group = np.cumsum(fresh[slot]) - 1
            mixed = np.zeros(int(group[-1]) + 1, bool)
            mixed[group[1:][(own[1:] != own[:-1]) & ~fresh[slot[1:]]]] = True
            slot = slot[mixed[group]]
            if not len(slot):
                break
        depth = min(depth, length - 5)
        group, key = np.cumsum(fresh[slot]).astype(U64), eight[window[order[slot]] + depth].astype(U64) >> U64(24)
        if len(slot) < 1 << 24:
            key |= group << U64(40)
            sub = np.argsort(key)
        else:
            sub = np.lexsort((key, group))
        order[slot], key = order[slot][sub], key[sub]
        fresh[slot[1:]] |= key[1:] != key[:-1]
        slot = slot[~fresh[slot] | np.append(~fresh[slot[1:]], False)]
        depth += 5
    if value is not None:
        after = np.flatnonzero(~fresh)
        if not _same_window(data, window[order[after]], window[order[after - 1]], length).all():
            return suffix_array(data, window, length)
    return order, fresh


def _parts(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first phrase, end phrase, first byte, prefix sums from there) of about a block each."""
    lo, stop = 0, at + size
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(stop, at[lo] + c.BLOCK_BYTES, "right")))
        yield lo, hi, at[lo], c.prefix_sums(data[at[lo] : stop[hi - 1]])
        lo = hi


def _same_window(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    if length < 8:
        return (data[a[:, None] + np.arange(length)] == data[b[:, None] + np.arange(length)]).all(1)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        out &= eight[a + k] == eight[b + k]
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, bool]:
    """(doc, tag, spans): the byte spans of each document that repeat a smaller document's; and whether ids repeat.

    `tag` tells apart rows that share an id: it is 0 if no id is repeated, else a hash of
    the text. A span is start * 2**32 + end; spans ascend and do not touch.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("ids have to be whole numbers")
    doc, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0
    again = docs.where(doc.isNotNull()).groupBy(doc).count().where("count > 1").limit(1).count() > 0
    tag = F.xxhash64(text) if again else F.lit(0).cast("long")
    n_ranges = max(1, -(-total // RANGE_BYTES))
    rows = c.small_batches(docs).where(doc.isNotNull()).select(doc.cast("long").alias("doc"), tag.alias("tag"), text.alias("text"))
    heavy = heavy_keys(rows.select("text"), total, length)
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    sent = rows.mapInArrow(_parse(n_ranges, n_buckets, length, heavy), "bin long, marks boolean, blob binary")
    marks = sent.groupBy("bin").applyInArrow(_order(n_buckets, length), "bucket long, blob binary")
    return marks.groupBy("bucket").applyInArrow(_gather, "doc long, tag long, spans array<long>"), again


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union; spans that touch become one."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.unique(spans)
    start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.append(True, start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _cut(form: str, carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = c.buffers(batch.column(1))
            spans = batch.column(2)
            value = spans.values.to_numpy(zero_copy_only=False) if len(spans) else np.zeros(0, np.int64)
            ends = spans.offsets.to_numpy()
            removed, count, kept = [], [], []
            for k in range(len(batch)):
                a, b = offsets[k], offsets[k + 1]
                start, end = merged(value[ends[k] : ends[k + 1]])
                data = raw[a:b]
                if len(start):
                    keep = np.ones(len(data), bool)
                    for s, e in zip(start, end, strict=True):
                        keep[s:e] = False
                    data = data[keep]
                removed.append(b - a - len(data))
                count.append(len(start))
                kept.append(hashlib.sha256(data).hexdigest() if form == "sha256" else data.tobytes() if form == "bytes" else data.tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(offsets[1:] - offsets[:-1]), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary() if form == "bytes" else pa.string()), *batch.columns[3:]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if form == "sha256" else "kept", *(f"c{k}" for k in range(carried))],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, form: str = "bytes", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, and what is kept.

    `form`: "bytes" gives `kept` as binary, "text" as text without the halves of characters that
    a cut leaves, "sha256" gives `kept_sha256`. The columns `keep` follow as c0, c1, ...
    """
    marks, again = repeated_spans(docs, id_col, text_col, length)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    carried = {f"c{k}": F.col(x).alias(f"c{k}") for k, x in enumerate(keep)}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *carried.values(), *([F.xxhash64(text).alias("own")] if again else []))
    on = F.col("doc_id") == F.col("doc")
    if again:
        on &= F.col("own") == F.col("tag")
    joined = rows.join(marks, on, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), *carried)
    last = {"sha256": "kept_sha256 string", "text": "kept string", "bytes": "kept binary"}[form]
    kinds = "".join(f", c{k} {kind}" for k, (_, kind) in enumerate(docs.select(*keep).dtypes)) if keep else ""
    return joined.mapInArrow(_cut(form, len(keep)), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}{kinds}")
