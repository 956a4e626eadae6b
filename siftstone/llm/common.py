"""Shared helpers: tables, shared folders, Arrow text buffers and rolling hashes.

Text columns reach Python as Arrow buffers; the helpers here work on the raw UTF-8
bytes of a few megabytes at a time, so no task holds more than a bounded block besides
the one document that it is reading.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19
#: Rows that go to Python at once, in place of Spark's 10000, as texts can be long.
BATCH_ROWS = 2000
U64 = np.uint64


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session send texts to Python BATCH_ROWS rows at a time, unless the user chose a size."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, BATCH_ROWS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="siftstone-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/siftstone-{uuid.uuid4().hex}"


_folders: list[str] = []


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back with the same schema."""
    path = shared_dir(df.sparkSession)
    _folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved() -> int:
    """How many folders this driver has saved and not let go."""
    return len(_folders)


def let_go(spark: SparkSession, first: int, end: int) -> None:
    """Delete the folders that were saved as number `first` up to `end`; nothing may read them any more."""
    for path in _folders[first:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _folders[first:end]


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever case it uses."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_kept: dict[tuple[str, ...], object] = {}


def kept(key: tuple[str, ...], make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: the last thing made."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forget() -> None:
    """Drop what the worker keeps."""
    if _kept:
        _kept.clear()
        give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system at its end, as Python workers outlive tasks.

    Unless it `keeps` something itself, it first drops what another operator's tasks have left in the worker.
    """

    @functools.wraps(run)
    def wrapped(batches):
        if not keeps:
            forget()
        yield from run(batches)
        give_back()

    return wrapped


def tidy_keeping(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return tidy(run, keeps=True)


# -- Arrow text ---------------------------------------------------------------------


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    kind = pa.large_binary()
    column = column.cast(kind).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: (first row, end row, bytes, offsets from 0)."""
    raw, offsets = buffers(column)
    limit = limit or BLOCK_BYTES
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# -- rolling hashes modulo 2**64 ------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 64)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with (S[e] - S[s]) * base**s a hash of data[s:e] that only depends on its bytes."""
    _, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(BYTE_CODE[data] * down[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, _ = powers(len(sums))
    return (sums[end] - sums[start]) * up[start]


#: Longer stretches are hashed by BLAKE2b: sums modulo 2**64 confuse some long strings whatever the base.
SHORT_BYTES = 32


def stretch_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], which depend on the bytes alone."""
    out = mix(span_hash(prefix_sums(data), start, end))
    for k in np.flatnonzero(end - start > SHORT_BYTES).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


# -- columns of whole numbers, packed -------------------------------------------------


def pack(first: np.ndarray, *rest: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, the first ascending as unsigned: byte planes, as many as the largest needs, compressed."""
    columns = [np.diff(first.view(U64), prepend=U64(0)), *(x.view(U64) for x in rest)]
    widths = [max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1 for x in columns]
    planes = [x.view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for x, w in zip(columns, widths, strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<IB{len(widths)}B", len(first), len(widths), *widths) + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = struct.unpack_from("<IB", raw)
    at, out = 5 + k, []
    for w in raw[5 : 5 + k]:
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :w] = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T
        out.append(whole.view(U64).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=U64)
    return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, by default [^\\x20\\x09-\\x0D]+: (start, end, row), none across two rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~blank[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = ink[cuts]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters U+00C0 to U+00DE."""
    out = LOWER[data]
    wide = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    out[1:][wide] += 0x20
    return out


#: Longer texts are not fitted on; with the number of rows this bounds what the driver gets.
FIT_CHARS = 60_000


def labelled(docs: DataFrame, labels: DataFrame, flag: str, learn: Column, rows: int, id_col: str = "doc_id", text_col: str = "text", chars: int = FIT_CHARS) -> DataFrame:
    """(label, place, text) of a bounded sample: of each label value at most `rows` labels, the least by hash of their
    id, and of these the texts of at most `chars` characters. `place` is a hash that puts them in one order.

    The labels that are broadcast to the documents are 2 * rows at most, whatever the input.
    """
    known = labels.where(learn & F.col(flag).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(flag).cast("int").alias("label"))
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(rows) for k in (0, 1)]
    some = F.broadcast(picked[0].union(picked[1]))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.join(some, docs[id_col] == some["id"]).where(F.length(text) <= chars).select("label", F.xxhash64("id", text).alias("place"), text.alias("text"))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def char_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    sums = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def keep_columns(batch: pa.RecordBatch, names: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns `names`, then the added ones."""
    at = {c: i for i, c in enumerate(batch.schema.names)}
    return pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), *added.values()], [*names, *added])
