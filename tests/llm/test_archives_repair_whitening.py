"""WARC archives, conversation repair and whitening against plain versions, and rows that are out of the ordinary."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import common, q11, registry, repair, warc, whitening

FOLDER = "/root/testdata/sf0.001"


def query(spark, name):
    return next(f for k, f in registry.queries().items() if k.startswith(name))(spark, FOLDER)


# -- archives ---------------------------------------------------------------------------

PAGES = [(k % 5, f"http://x/{k}", ["a", "b", "", None, "日本퟿"][k % 5] if k % 3 else "same") for k in range(40)]
PAGES += [(None, None, "same"), (None, None, "only null ids"), (None, "u", "only null ids"), (7, "http://a b\r\n%20é", "same"), (9, "u", "same"), (9, "u", "same"), (10, "v", "x" * 3_000_000)]


def archived(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("file", F.lit(1))


@pytest.mark.parametrize("limit", [500_000, 0])
def test_archives(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", limit)
    monkeypatch.setattr(warc, "HEAVY", 3 if limit == 0 else warc.HEAVY)
    folder = common.shared_dir(spark)
    index = warc.write(archived(spark, PAGES), folder)
    got = warc.read(index, folder, payload=True).collect()
    sql = q11.SQL.replace("FROM pages", "FROM (SELECT unnest($a) AS page_id, unnest($h) AS html)")
    want = duckdb.execute(sql, {"a": [x[0] for x in PAGES], "h": [x[2] for x in PAGES]}).fetchall()
    assert sorted(((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got), key=repr) == sorted(want, key=repr)
    texts = {(a, b): c or "" for a, b, c in PAGES}
    assert all(bytes(g.payload).decode() == texts[g.page_id, g.url] for g in got if g.record_type == "response")
    some = warc.read(index, folder, F.col("url").endswith("7")).collect()
    assert sorted(r.url for r in some) == sorted(u for _, u, _ in PAGES if u and u.endswith("7"))


def test_archive_small_files_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    folder = common.shared_dir(spark)
    index = warc.write(archived(spark, PAGES), folder, least_bytes=2)
    files = index.select("file").distinct().count()
    got = warc.read(index, folder).collect()
    assert len(got) == len(PAGES) and files > 3
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 2)
    assert warc.read(warc.write(archived(spark, []), common.shared_dir(spark)), folder).collect() == []


def test_ranges():
    offset, length = np.array([0, 10, 20, 500, 900]), np.array([10, 10, 10, 10, 10])
    assert list(warc.runs(["a"] * 5, offset, length, 100, 10_000)) == [(0, 3), (3, 4), (4, 5)]
    assert list(warc.runs(["a"] * 5, offset, length, 1000, 10_000)) == [(0, 5)]
    assert list(warc.runs(["a"] * 5, offset, length, 1000, 25)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(warc.runs(["a", "a", "b", "b", "b"], offset, length, 1000, 10_000)) == [(0, 2), (2, 5)]
    assert list(warc.runs([], offset[:0], length[:0])) == []


def test_damaged_archive():
    _, data = warc.record("response", "1", "u", None, b"abc", "2020-01-01T00:00:00Z")
    raw = bytearray(zlib.decompress(data, 31))
    raw[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(warc.member(bytes(raw)))


def test_op11(spark):
    duckdb.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    assert sorted(map(tuple, query(spark, "op11_").collect()), key=repr) == sorted(duckdb.execute(q11.SQL).fetchall(), key=repr)


# -- repair -----------------------------------------------------------------------------


def plain_repair(rows):
    """Every way to edit, least cost and then least letters first."""
    grouped: dict = {}
    for conv, turn, role, text in rows:
        kept = grouped.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {conv: plain_conversation(conv, kept) for conv, kept in grouped.items()}


MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_conversation(conv, rows):
    rows = sorted(rows, key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    turns = {r[0] for r in rows if r[0] is not None}
    seen, faults = set(), []
    for _, role, text in rows:
        ink = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, letter, initial, line, i, inserts=0):
            after = state if initial is None else MOVES.get((state, initial))
            rest = None if after is None else best(i, after, inserts)
            if rest:
                found.append((cost + rest[0], letter + rest[1], line + rest[2]))

        for role in ("user", "assistant"):
            if inserts < 2:
                add(3, "I", role[0], (f"{role}:",), i, inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            more = 3 if faults[i] == "truncated" else 0
            add(4, "D", None, (), i + 1)
            if faults[i] not in ("blank", "duplicate"):
                add(more, "K", role[:1], (f"{role}:{text}",), i + 1)
                for new in ("user", "assistant"):
                    add(3 + more, "R", new[0], (f"{new}:{text}",), i + 1)
        return min(found, key=lambda x: x[:2]) if found else None

    for i in range(len(rows), -1, -5):
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, lines = best(0, "", 0)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def same_repair(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("g", F.lit(1)).withColumn("cost", F.lit("clash"))
    got = sorted(map(tuple, repair.repair(df).collect()), key=repr)
    assert got == sorted(plain_repair(rows).values(), key=repr)


@pytest.mark.parametrize("size", [2, 3, 256])
def test_repair(spark, monkeypatch, size):
    monkeypatch.setattr(repair, "CHUNK_ROWS", size)
    rng = random.Random(size)
    texts = ["a.", "b?", "c", "  ", None, "", "long " * 40 + "a", "long " * 40 + "b.", "q!", "\x1cx"]
    rows = [(1 if rng.random() < 0.4 else rng.choice([1, 2, 3, None, *range(10, 40)]), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice([*texts, f"{rng.random()}."])) for _ in range(200)]
    same_repair(spark, [*rows, *rows[:9]])


def test_repair_chunks_that_never_agree(spark, monkeypatch):
    """Truncated rows of an unknown role leave the shape of the costs as it is, so their chunks are joined by doubling."""
    monkeypatch.setattr(repair, "CHUNK_ROWS", 2)
    assert len(set(repair.entry_of([7] * 40))) > 1
    same_repair(spark, [*((1, k, "x", str(k)) for k in range(100)), *((2, k, "user", "same.") for k in range(30))])


def test_repair_shapes():
    assert len(repair.SHAPES) < 256 and repair.BEFORE.shape == (repair.GONE + 1, len(repair.SHAPES))
    rng = random.Random(1)
    for _ in range(50):
        kinds = [rng.randrange(9) for _ in range(rng.randrange(60))]
        spec = repair.backward(kinds, 0)
        for end in range(len(repair.SHAPES)):
            true = repair.backward(kinds, end)
            assert repair.rerun(spec, kinds, end) == true
            assert repair.entry_of(kinds)[end] == true[0]


def test_repair_odd_tables(spark):
    same_repair(spark, [(1, None, None, None), (1, None, None, None), (None, None, None, None), (2, 5, "user", "x" * 100_000)])
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    same_repair(spark, [(dropped, 0, "user", "a.")])
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_op12(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    assert sorted(map(tuple, query(spark, "op12_").collect())) == sorted(plain_repair(rows).values())


# -- whitening --------------------------------------------------------------------------


def plain_whitening(rows, most=8):
    """(n, x, deviations, whitened up to signs, explained) by numpy's own eigenvectors."""
    x = np.floor(1024 * np.array([v for _, v in rows], float)) + 100_000
    n, y = len(x), x - x.mean(0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    z = (n * x - x.sum(0)).astype(np.int64).astype(object)
    return n, [int(t) for t in (z * z).sum(1)], y @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_op13(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, whitened, explained = plain_whitening(rows)
    got = {(r.vec_id, r.component): r for r in query(spark, "op13_").collect()}
    assert len(got) == 8 * n and all(r.n == n and 0 <= r.identity_error <= 1e-4 for r in got.values())
    own = np.array([[got[i, k].whitened for k in range(1, 9)] for i, _ in rows])
    assert np.abs(own * np.sign((own * whitened).sum(0)) - whitened).max() < 1e-9
    assert [got[i, 1].deviation for i, _ in rows] == deviation
    assert np.allclose([got[rows[0][0], k].explained for k in range(1, 9)], explained, rtol=1e-9)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(k % 7 or None, rng.normal(size=3).tolist()) for k in range(40)]
    bad = [(1, None), (2, [1.0, None, 2.0]), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 0.0, 0.0]), (5, []), (6, [1.0, 2.0]), (7, [1.0] * 4)]
    df = spark.createDataFrame([*good, *good[:3], *bad], "vec_id long, embedding array<double>").withColumn("n", F.lit("clash"))
    got = whitening.whiten(df).collect()
    n, deviation, whitened, _ = plain_whitening([*good, *good[:3]])
    assert len(got) == 3 * n and {r.n for r in got} == {n}
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation)
    assert np.allclose(np.sort([abs(r.whitened) for r in got if r.component == 2]), np.sort(np.abs(whitened[:, 1])))
    flat = spark.createDataFrame([(k, [1.0, 2.0, float(k % 2)]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    for rows in ([], [(1, [1.0, 2.0])], [(1, [0.5]), (2, [0.5])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_eigen(size):
    rng = np.random.default_rng(size)
    for rank in {1, max(1, size // 2), size}:
        m = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-3, 4, rank)
        v = m @ m.T
        values, vectors = whitening.eigen(v)
        assert len(values) <= rank or rank == size
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
        assert np.allclose(vectors * values @ vectors.T, v, atol=1e-9 * values[0])
        assert (np.diff(values) <= 0).all()


def test_large_deviations():
    z = np.array([[3_000_000_000, 3_000_000_000, 4]], np.int64)
    assert int(whitening.deviations(z)[0].as_py()) == 2 * 3_000_000_000**2 + 16


def test_shared_folder_without_a_setting(spark):
    """On a local master a folder of its own is used, and no setting of the session is touched."""

    class Bare:
        sparkContext = spark.sparkContext

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    a, b = common.shared_dir(Bare), common.shared_dir(Bare)
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
