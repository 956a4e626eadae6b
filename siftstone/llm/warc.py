"""WARC archives: written with an index, read back by byte ranges.

Writing gives every page a record, in files of gzip members (one a record) in the shared folder, and returns the
index: file, offset, length, URL and digest of each record. Reading starts from the index alone: the records that are
selected are dealt out and sorted by file and offset, and neighbours are fetched by one read; what is not selected is
never touched. Tasks open the shared folder by pyarrow's file systems, so its scheme must be one of theirs.

Of records with equal payloads that with the largest page_id is a response and the others revisit it; which payloads
repeat is counted by digest, so pages themselves are only shuffled where more than BROADCAST_GROUPS payloads repeat, and
then not by a digest that a large share of all rows has.

A task that is run again writes a file of its own; the index names the file of the task that was counted, so a
file left by a lost one is never read.

Rows: a null html is an empty payload and an empty one a record as any other; a null id counts as less than all others,
and rows that share payload and largest id are responses all of them, as are those of a payload that has null ids only.
A null URL has no header. Very long pages are one record each, an empty table has an empty index, and extra columns are
not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: A file is closed once it has as many bytes.
FILE_BYTES = 1 << 30
#: Neighbours are fetched by one read of up to RANGE_BYTES, across gaps of up to GAP_BYTES.
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: Bytes of records that one task reads, about.
TASK_BYTES = 64 << 20
#: Repeated payloads that are broadcast; beyond it the pages are shuffled.
BROADCAST_GROUPS = 500_000
#: A payload with more than this share of all rows is broadcast even then; there are at most as many of them.
HEAVY = 10_000
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, record_type string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{of}:{page}')}>"


def record(kind: str, page: str | None, url: str | None, refers_to: str | None, payload: bytes, date: str) -> tuple[str, bytes]:
    """(digest of the payload, the record as a gzip member). A revisit holds the HTTP header but no payload."""
    of = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == RESPONSE else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page or '', of)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    if page is not None:
        lines.append(f"X-Page-ID: {quote(page, safe=_PLAIN)}")
    if kind == REVISIT:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to or '', of)}", f"X-Refers-To-Page-ID: {quote(refers_to or '', safe=_PLAIN)}"]
    lines += [f"WARC-Payload-Digest: sha1:{of}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return of, member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


_PLAIN = "".join(chr(k) for k in range(0x21, 0x7F) if chr(k) != "%")


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header, HTTP header (names in lower case) and payload of a record; damaged ones are an error."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    header = _fields(head)
    block = rest[: int(header["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or header["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"a record of {len(data)} bytes is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    return header, _fields(http), payload


def _fields(block: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _latest(rows: DataFrame, least_bytes: int) -> DataFrame:
    """Adds `latest`, the largest page_id of the rows with the same payload, where there are several."""
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    repeated = c.save(groups.where("n > 1"))
    size = repeated.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if size["groups"] <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(repeated.select("sha", "latest")), "sha", "left")
    # no digest that is left has more than one in HEAVY of the repeated rows; rows of the others get keys of their own
    heavy = F.col("n") * HEAVY > size["rows"]
    some = rows.join(F.broadcast(repeated.where(heavy).select("sha", F.col("latest").alias("_heavy"), F.lit(True).alias("_known"))), "sha", "left")
    key = F.when(F.col("_known"), F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("sha"))
    rest = some.withColumn("_key", key).join(repeated.where(~heavy).select(F.col("sha").alias("_key"), "latest"), "_key", "left")
    return rest.withColumn("latest", F.when(F.col("_known"), F.col("_heavy")).otherwise(F.col("latest"))).drop("_key", "_heavy", "_known")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write all pages to archives in the folder; the index, saved: file, offset, length, page_id, url, digest, record_type.

    Payloads of fewer than `least_bytes` bytes are responses even if they repeat.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha"))
    same = F.col("latest").isNull() | F.coalesce(F.col("page_id") == F.col("latest"), F.lit(False))
    told = _latest(rows, least_bytes).select(F.col("page_id").cast("string").alias("page"), "url", F.when(~same, F.col("latest").cast("string")).alias("refers_to"), "html", "page_id")

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                found = []
                for page, url, refers_to, html in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                    if out is None:
                        store, place = _open(folder)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{place}/{name}", compression=None, buffer_size=1 << 20)
                        info = b"software: siftstone\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        first = member(head.encode() + info + b"\r\n\r\n")
                        out.write(first)
                        offset = len(first)
                    kind = REVISIT if refers_to is not None else RESPONSE
                    of, data = record(kind, page, url, refers_to, html.as_buffer().to_pybytes(), date)
                    out.write(data)
                    found.append((name, offset, len(data), url, of, kind))
                    offset += len(data)
                    if offset >= FILE_BYTES:
                        out.close()
                        out = None
                columns = zip(*found, strict=True) if found else ([] for _ in range(6))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, kinds, strict=True)), batch.column(4)], ["file", "offset", "length", "url", "digest", "record_type", "page_id"])
        finally:
            if out is not None:
                out.close()

    store = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    store.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(store)
    return c.save(told.mapInArrow(run, f"{INDEX}, page_id {dict(pages.dtypes)[id_col]}"))


def runs(file: list[str], offset: np.ndarray, length: np.ndarray, gap: int | None = None, most: int | None = None) -> Iterator[tuple[int, int]]:
    """First and end row of each read: rows that follow one another in a file, sorted by offset; the same record may come again."""
    gap, most = GAP_BYTES if gap is None else gap, most or RANGE_BYTES
    lo = 0
    for k in range(1, len(file) + 1):
        if k == len(file) or file[k] != file[lo] or offset[k] > offset[k - 1] + length[k - 1] + gap or offset[k] + length[k] > offset[lo] + most:
            yield lo, k
            lo = k


def read(index: DataFrame, folder: str, where: Column | None = None, payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the selected records, and `payload` on request.

    Size and digest of a revisit are those of the payload that it stands for; its own payload is null.
    """
    kind = dict(index.dtypes)["page_id"]
    chosen = (index if where is None else index.where(where)).select("file", "offset", "length", "page_id", "url")
    total = chosen.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(-(-total // TASK_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    dealt = chosen.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _open(folder)
        name, source = None, None
        for batch in batches:
            file, offset, length = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi in runs(file, offset, length):
                if file[lo] != name:
                    if source is not None:
                        source.close()
                    name, source = file[lo], store.open_input_file(f"{place}/{file[lo]}")
                start = int(offset[lo])
                data = source.read_at(int(offset[hi - 1] + length[hi - 1]) - start, start)
                found = [_row(data[o - start : o - start + n]) for o, n in zip(offset[lo:hi].tolist(), length[lo:hi].tolist(), strict=True)]
                size, of, what, refers_to, content = zip(*found, strict=True)
                columns = [batch.column(3)[lo:hi], batch.column(4)[lo:hi], pa.array(size, pa.int64()), pa.array(of, pa.string()), pa.array(what, pa.string()), pa.array(refers_to, pa.string())]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if payload:
                    columns.append(pa.array(content, pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names)
        if source is not None:
            source.close()

    schema = f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + (", payload binary" if payload else "")
    return dealt.mapInArrow(run, schema).withColumn("refers_to", F.col("refers_to").cast(kind))


def _row(data: bytes) -> tuple[int, str, str, str | None, bytes | None]:
    header, http, payload = parsed(data)
    of, size = header["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
    if header["warc-type"] == REVISIT:
        return size, of, REVISIT, unquote(header["x-refers-to-page-id"]), None
    if digest(payload) != of or len(payload) != size:
        raise ValueError("a payload is not what its record says")
    return size, of, RESPONSE, None, payload
