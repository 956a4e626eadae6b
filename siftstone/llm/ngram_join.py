"""Jaccard join of documents on word shingles, as a blocked sparse matrix product.

The incidence matrix has a row for each distinct shingle set and a column for each shingle.
Sets that are equal become one row at once. The product of the matrix with its transpose is
taken block by block of columns, over the columns that can decide a pair only: with shingles
in one global order, two sets of sizes a >= b that link share a shingle among the first
a - ceil(0.75 a) + 1 of the one and the first b - ceil(6 b / 7) + 1 of the other. Columns that
many rows have come last in that order, so they seldom decide anything.

* Blocks are ranges of shingles. What goes to a block is counted and packed in the task that
  reads the texts, so a shingle that most rows have comes once from each of its flushes.
* Light columns: a block multiplies each column with itself, adds up how many columns a pair shares
  and keeps the pairs that sizes and places still allow.
* Heavy columns (rows of near copies) are not multiplied at once. Each row is first compared with one
  other: the smallest row of most of its heavy columns, and the smaller row with which it shares most
  light columns. Rows that link are one component. Heavy columns whose rows are all of one component
  are done; the rest are joined across components, as are the pairs of light columns. The rows of a
  column are dealt to a grid of cells of GRID_ROWS rows either way, so no task has a column whole.
* A pair that is left is dropped if the parities of its shingles differ in so many places that
  its overlap cannot reach 3 / 7 of both sizes together; then the whole texts are compared.

No link is lost: every step but the last comparison only drops pairs that cannot link or
that are in one component by links already found. Components come from iterated joins.

Rows: a null or empty text, or one without words, has an empty set, is linked with nothing and
is its own component. Rows that share an id are one document with several texts: each text links by
itself, and the id's component holds them all. Rows with a null id link with nothing and have a
null component. Repeated rows get equal results. An empty table gives an empty result, extra
columns are not looked at, and texts are read whole however long they are. Shingles are
told apart by 64-bit hashes of their words' 64-bit hashes (BLAKE2b for words of more than 32 bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

SHINGLE = 5
#: A column is heavy if more rows have it among their first shingles.
HEAVY_ROWS = 16
#: At most so many columns are put last, the heaviest; this bounds what is broadcast, and
#: touches the order of columns only, never the pairs.
HEAVY_COLUMNS = 1_000_000
#: Ids are broadcast up to this many; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Shingles that a task counts before it sends them on, and that a block holds in the mean.
FLUSH = 2_000_000
BLOCK = 1_000_000
#: Rows of a heavy column that meet in one cell, either way.
GRID_ROWS = 1000
BITS = 1024
U64 = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each row, offsets into them); A-Z are lower-cased."""
    n = len(offsets) - 1
    data = c.LOWER[data]
    start, end, row = c.words(data, offsets)
    word = c.stretch_hash(data, start, end)
    count = np.bincount(row, minlength=n)
    at = np.cumsum(count) - count
    if len(word) >= size:
        roll = word[: len(word) - size + 1]
        for k in range(1, size):
            roll = c.mix(roll) + word[k : len(word) - size + 1 + k]
        inside = row[: len(roll)] == row[size - 1 :]
        roll, roll_row = roll[inside], row[: len(roll)][inside]
    else:
        roll, roll_row = np.zeros(0, U64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = word[at[few]]
        for k in range(1, size - 1):
            more = count[few] > k
            short[more] = c.mix(short[more]) + word[at[few][more] + k]
        roll = np.concatenate([roll, c.mix(short + count[few].astype(U64))])
        roll_row = np.concatenate([roll_row, few])
        order = np.argsort(roll_row, kind="stable")
        roll, roll_row = roll[order], roll_row[order]
    ends = np.searchsorted(roll_row, np.arange(n + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        roll[a:b].sort()
    fresh = np.ones(len(roll), bool)
    fresh[1:] = (roll[1:] != roll[:-1]) | (roll_row[1:] != roll_row[:-1])
    return roll[fresh], np.concatenate([[0], np.cumsum(np.bincount(roll_row[fresh], minlength=n))])


def probe_length(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def index_length(n: np.ndarray) -> np.ndarray:
    return n - (6 * n + 6) // 7 + 1


#: The same as SQL.
PROBE, INDEX = "({n} - (3 * {n} + 3) div 4 + 1)", "({n} - (6 * {n} + 6) div 7 + 1)"


def parities(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row the parity of its shingles in each of BITS places, packed."""
    n = len(ends) - 1
    place = np.repeat(np.arange(n), np.diff(ends)) * BITS + (sets & U64(BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, shingles, offsets) of blocks of (doc, text) rows."""
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in c.blocks(batch.column(1)):
            yield ids[lo:hi], *shingles(data, offsets)


@c.tidy
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets, ends in _rows(batches):
        raw = sets.tobytes()
        keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        bits = [x.tobytes() for x in parities(sets, ends)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends)), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())], ["doc", "n", "key", "bits"])


def _first_columns(ids: pa.Array, sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row) for the shingles that a row is found by, in plain order."""
    n = np.diff(ends)
    size = np.where(n > 0, index_length(n), 0)
    return sets[c.ranges(ends[:-1], size)], np.repeat(np.arange(len(n)), size)


def _columns_beside(spread) -> Callable[[pa.Array, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(shingle, row) for all shingles of the rows that a crowded column would find."""

    def pick(ids: pa.Array, sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, row = _first_columns(ids, sets, ends)
        touched = np.unique(row[_is_in(first, spread.value)])
        n = np.diff(ends)[touched]
        return sets[c.ranges(ends[touched], n)], np.repeat(touched, n)

    return pick


def _dealt(token: np.ndarray, columns: list[np.ndarray], blocks: int) -> pa.RecordBatch:
    """(block, packed columns), from columns in order of `token`."""
    block = ((token >> U64(32)) * U64(blocks)) >> U64(32)
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    packed = [c.pack(token[a:b], *(x[a:b] for x in columns)) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(token)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[cut].astype(np.int64)), pa.array(packed, pa.binary())], ["block", "packed"])


def _tally(pick, blocks: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, packed (shingle, rows, smallest row)) of the shingles that `pick` takes."""

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(token)
            token, doc = token[order], doc[order]
            cut = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            return _dealt(token[cut], [np.diff(np.append(cut, len(token))), np.minimum.reduceat(doc, cut)], blocks)

        for batch in batches:
            for ids, sets, ends in _rows([batch]):
                token, row = pick(ids, sets, ends)
                if len(token):
                    held.append((token, ids.to_numpy(zero_copy_only=False).astype(np.int64)[row]))
                    size += len(token)
                if size > most:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _crowded(heavy_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(token, rows, hub) of the shingles of one block that more than `heavy_rows` rows have; hub is the smallest."""

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [c.unpack(x.as_py()) for batch in batches for x in batch.column("packed")]
        token, rows, hub = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(token)
        token = token[order]
        cut = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        rows, hub = np.add.reduceat(rows[order], cut).view(np.int64), np.minimum.reduceat(hub[order].view(np.int64), cut)
        many = rows > heavy_rows
        yield pa.RecordBatch.from_arrays([pa.array(token[cut][many].view(np.int64)), pa.array(rows[many]), pa.array(hub[many])], ["token", "rows", "hub"])

    return run


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _ordered(sets: np.ndarray, ends: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, row, place, size of row, place in `heavy` or -1) of each row's deciding columns."""
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    found = np.searchsorted(heavy, sets) if len(heavy) else np.zeros(len(sets), np.int64)
    known = np.minimum(found, max(0, len(heavy) - 1))
    is_heavy = heavy[known] == sets if len(heavy) else np.zeros(len(sets), bool)
    order = np.argsort(row * 2 + is_heavy, kind="stable")
    place = np.arange(len(sets)) - ends[:-1][row]
    deciding = place < probe_length(n)[row]
    picked = order[deciding]
    return sets[picked], row[deciding], place[deciding], n[row[deciding]], np.where(is_heavy[picked], known[picked], -1)


def _heavy_rows(spread) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, hubs = spread.value
        for ids, sets, ends in _rows(batches):
            token, row, _, n, at = _ordered(sets, ends, heavy)
            has = at >= 0
            if not has.any():
                continue
            token, row, n, at = token[has], row[has], n[has], at[has]
            doc = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            near = []
            for a, b in zip(cut, np.append(cut[1:], len(row)), strict=True):
                hub, votes = np.unique(hubs[at[a:b]], return_counts=True)
                votes[hub == doc[row[a]]] = 0
                near.append(int(hub[np.argmax(votes)]) if votes.max() else None)
            offsets = pa.array(np.append(cut, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[cut]]), pa.array(n[cut]), pa.array(near, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(token.view(np.int64)))], ["doc", "n", "hub", "tokens"])

    return run


def _light_rows(spread, blocks: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, packed (shingle, row, size, place)) of the deciding columns that are not heavy."""

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, _ = spread.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            order = np.argsort(columns[0])
            return _dealt(columns[0][order], [x[order] for x in columns[1:]], blocks)

        for batch in batches:
            for ids, sets, ends in _rows([batch]):
                token, row, place, n, at = _ordered(sets, ends, heavy)
                light = at < 0
                held.append((token[light], ids.to_numpy(zero_copy_only=False).astype(np.int64)[row[light]], n[light], place[light]))
                size += len(held[-1][0])
                if size > most:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


@c.tidy
def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, votes): pairs of rows that share columns of one block, and how many."""
    held = [c.unpack(x.as_py()) for batch in batches for x in batch.column("packed")]
    token, doc, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.argsort(token)
    token, doc, n, place = token[order], *(x[order].view(np.int64) for x in (doc, n, place))
    left = np.flatnonzero(token[1:] == token[:-1])
    found, size, gap = [], 0, 1
    while len(left):
        a, b = left, left + gap
        swap = (n[a] < n[b]) | ((n[a] == n[b]) & (doc[a] > doc[b]))
        x, y = np.where(swap, b, a), np.where(swap, a, b)
        rest = np.minimum(n[x] - place[x], n[y] - place[y])
        ok = (doc[x] != doc[y]) & (4 * n[y] >= 3 * n[x]) & (place[y] < index_length(n[y])) & (7 * rest >= 3 * (n[x] + n[y]))
        found.append((np.minimum(doc[x[ok]], doc[y[ok]]), np.maximum(doc[x[ok]], doc[y[ok]])))
        size += len(found[-1][0])
        if size > 500_000:
            yield _voted(found)
            found, size = [], 0
        gap += 1
        left = left[left + gap < len(token)]
        left = left[token[left + gap] == token[left]]
    if size:
        yield _voted(found)


def _voted(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    both = pd.DataFrame({k: np.concatenate(x) for k, x in zip("ab", zip(*found, strict=True), strict=True)}).groupby(["a", "b"], sort=False).size().reset_index(name="votes")
    return pa.RecordBatch.from_arrays([pa.array(both[k].to_numpy(np.int64)) for k in ("a", "b", "votes")], ["a", "b", "votes"])


@c.tidy
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), BITS // 8) for k in (4, 5)]
        differ = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
        both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        ok = pa.array(7 * ((both - differ) // 2) >= 3 * both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(ok)


@c.tidy
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        right, sizes = c.buffers(batch.column(3))
        for lo, hi, data, offsets in c.blocks(batch.column(2)):
            one, one_ends = shingles(data, offsets)
            two, two_ends = shingles(right[sizes[lo] : sizes[hi]], sizes[lo : hi + 1] - sizes[lo])
            ok = []
            for k in range(hi - lo):
                x, y = one[one_ends[k] : one_ends[k + 1]], two[two_ends[k] : two_ends[k + 1]]
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(common > 0 and 100 * common >= 75 * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def among(rows: DataFrame, on: str, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose `on` is (not) among the distinct ids; broadcast if they are few enough."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, rows[on] == ids["id"], how)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that the edges (a, b) reach from each id that has one.

    Least labels travel along the edges, and each round a label also jumps to its own label.
    """
    both = c.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = c.save(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        before = c.saved()
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "root", F.least("root", "near").alias("to"))
        jump = lower.select(F.col("id").alias("at"), F.col("to").alias("on"))
        new = c.save(lower.join(jump, lower["to"] == jump["at"], "left").select("id", F.least("to", F.coalesce("on", "to")).alias("root"), (F.least("to", F.coalesce("on", "to")) < F.col("root")).alias("moved")))
        c.let_go(new.sparkSession, before - 1, before)  # the labels that these come from
        labels = new.select("id", "root")
        if not new.where("moved").limit(1).count():
            return labels


def _pairs_with(pairs: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """Pairs (a, b) with the columns `names` of the table (id, ...) for a, then for b."""
    for side in "ab":
        own = table.select(F.col("id").alias(f"{side}_id"), *(F.col(x).alias(f"{side}_{x}") for x in names))
        pairs = pairs.join(own, pairs[side] == own[f"{side}_id"]).drop(f"{side}_id")
    return pairs.select("a", "b", *(f"{side}_{x}" for x in names for side in "ab"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    text = c.small_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not text.where("doc is not null").groupBy("doc").count().where("count > 1").limit(1).count():
        return _link(text).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))
    # ids repeat: rows are linked by numbers of their own, then the rows of an id are one
    rows = c.save(text.withColumn("row", F.when(F.col("doc").isNotNull(), F.monotonically_increasing_id())))
    found = c.save(_link(rows.select(F.col("row").alias("doc"), "text")))
    known = found.where("doc is not null").withColumnRenamed("doc", "row").join(rows.select("row", F.col("doc").alias("own")), "row").select("own", "n", "root")
    least = known.groupBy("root").agg(F.min("own").alias("low"))
    classes = components(known.join(least, "root").where("own <> low").select(F.col("own").alias("a"), F.col("low").alias("b")))
    named = known.drop("root").join(classes, known["own"] == classes["id"], "left").select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "own").alias("component_id"))
    return named.union(found.where("doc is null").select("doc", "n", F.lit(None).cast("long")))


def _link(text: DataFrame) -> DataFrame:
    """(doc, n, root) of each row of (doc, text), where no id but null repeats."""
    spark = text.sparkSession
    rows = c.save(text.mapInArrow(_describe, "doc long, n long, key binary, bits binary"))
    sets = rows.where("doc is not null and key is not null")
    least = sets.groupBy("key").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    # only sets that come more than once have another representative than the row itself
    shared = c.save(sets.select("doc", "key").join(least.where("copies > 1").select("key", "rep"), "key").where("doc <> rep").select(F.col("doc").alias("id"), "rep"))
    gone = shared.select("id")
    words = among(text.where("doc is not null"), "doc", gone, "left_anti")
    table = among(sets, "doc", gone, "left_anti").select(F.col("doc").alias("id"), "n", "bits")
    blocks = max(1, -(-(sets.agg(F.sum("n").alias("n")).first()["n"] or 0) // BLOCK))

    def crowded(pick) -> tuple[np.ndarray, np.ndarray]:
        """Columns of more than HEAVY_ROWS rows in order, the fullest HEAVY_COLUMNS at most, and the smallest row of each."""
        sent = words.mapInArrow(_tally(pick, blocks, FLUSH), "block long, packed binary")
        found = c.save(sent.groupBy("block").applyInArrow(_crowded(HEAVY_ROWS), "token long, rows long, hub long"))
        level = F.floor(8 * F.log2("rows"))
        least, total = None, 0
        for r in found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
            total += r["count"]
            if total > HEAVY_COLUMNS:
                break
            least = r["level"]
        kept = found.where(level >= least if least is not None else F.lit(False)).select("token", "hub").toArrow()
        tokens, hubs = (kept.column(k).to_numpy() for k in ("token", "hub"))
        order = np.argsort(tokens.view(U64))
        return tokens.view(U64)[order], hubs[order]

    # columns that crowd the places a row is found by; then all that go with them, lest they take those places
    first = spark.sparkContext.broadcast(crowded(_first_columns)[0])
    spread = spark.sparkContext.broadcast(crowded(_columns_beside(first)))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link; a and b are distinct ids."""
        sized = _pairs_with(pairs, table, ["n", "bits"]).where("4 * least(a_n, b_n) >= 3 * greatest(a_n, b_n)")
        left = c.save(sized.mapInArrow(_possible, "a long, b long"))
        ids = left.select(F.col("a").alias("id")).union(left.select(F.col("b"))).distinct()
        texts = among(words, "doc", c.save(ids), "left_semi").select(F.col("doc").alias("id"), "text")
        return c.save(_pairs_with(left, texts, ["text"]).mapInArrow(_linked, "a long, b long").distinct())

    near = c.save(words.mapInArrow(_heavy_rows(spread), "doc long, n long, hub long, tokens array<long>"))
    light = words.mapInArrow(_light_rows(spread, -(-blocks // 3), FLUSH // 2), "block long, packed binary")
    shared_columns = c.save(light.groupBy("block").applyInArrow(_product, "a long, b long, votes long").groupBy("a", "b").agg(F.sum("votes").alias("votes")))
    # one partner for each row
    stars = near.where("hub is not null").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b"))
    best = shared_columns.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b")
    stars = verified(stars.union(best).distinct())
    found = components(stars)

    def root(side: Column, name: str) -> Column:
        return F.coalesce(F.col(name), side)

    # heavy columns: across components only, where there are several, and only from places that can decide the pair
    rooted = near.join(found, near["doc"] == found["id"], "left").select("doc", "n", F.size("tokens").alias("own"), "tokens", root(F.col("doc"), "root").alias("root"))
    place = F.expr(f"{PROBE.format(n='n')} - own + at")
    column = rooted.select(F.posexplode("tokens").alias("at", "token"), "doc", "n", "own", "root").select("token", "doc", "n", place.alias("place"), "root")
    mixed = column.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / GRID_ROWS).cast("int").alias("cells")).where("low < high").select("token", "cells")
    left = column.join(mixed, "token")
    own, all_cells = F.pmod(F.xxhash64("doc"), "cells"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    right = left.where(f"place < {INDEX.format(n='n')}").select("token", all_cells.alias("x"), own.alias("y"), *(F.col(x).alias(f"{x}2") for x in ("doc", "n", "place", "root")))
    left = left.select("token", own.alias("x"), all_cells.alias("y"), "doc", "n", "place", "root")
    decides = "root <> root2 and (n > n2 or n = n2 and doc < doc2) and 4 * n2 >= 3 * n and 7 * least(n - place, n2 - place2) >= 3 * (n + n2)"
    across = left.join(right, ["token", "x", "y"]).where(decides).select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b"))
    pairs = shared_columns.select("a", "b").union(across).distinct()
    for side in "ab":
        own = found.select(F.col("id").alias(f"{side}_id"), F.col("root").alias(f"{side}_root"))
        pairs = pairs.join(own, pairs[side] == own[f"{side}_id"], "left")
    pairs = pairs.where(root(F.col("a"), "a_root") != root(F.col("b"), "b_root")).select("a", "b")
    links = verified(pairs)

    final = components(stars.union(links)).withColumnRenamed("id", "node")
    out = rows.select("doc", "n").join(shared, F.col("doc") == F.col("id"), "left").withColumn("rep", F.coalesce("rep", "doc"))
    return out.join(final, out["rep"] == final["node"], "left").select("doc", "n", F.coalesce("root", "rep").alias("root"))
