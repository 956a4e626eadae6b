"""Repair of conversations to the form `(s?(ua)+)?` of role initials, at least cost.

The cheapest edits are a shortest path: from each place and state (nothing yet, after s, after u, after a) the least
cost to the end follows from the place after it, backwards. To run one conversation in many tasks its rows are cut into
chunks, and every chunk starts from a speculative cost vector at its end, that of a conversation's end. Only
differences inside a vector decide an edit, and there are few such shapes (SHAPES), which are numbered, so
vectors that differ by a constant have one number. Most chunks come to one shape whatever stood at their end (the products
of their steps have rank one); their neighbours are then settled at once, and runs of the others are joined by doubling, in
a number of rounds that is the logarithm of their length. A fix-up reruns each chunk from the end that is now known until
it meets the shape that the speculation had there. Then each chunk is traced, least letter first, from every state
that it could start in; start states are settled in the same way, and the pieces are stitched.

Rows are dealt by ranges of conversation and place, so a conversation of any length is spread over tasks, and rows that are
alike in everything may be parted. A conversation that lies inside one task's range is finished there. Whether role and text
were seen in an earlier chunk is found by joining the chunks' distinct keys. The digest of the repaired text is
one running hash, so the last step reads a conversation's pieces in order in one task, a chunk at a time.

Rows: nulls in role and text are one space, also in the text that decides the damage; a null conv_id is a conversation of its
own, null turns come first. Rows of one turn are ordered by role, then by the first 64 characters of the text, then by the MD5
of the whole. Repeated rows are duplicates of the first. Empty and very long texts are rows as any other, a conversation that
loses all rows has zeros, an empty audit and the hash of nothing, an empty table has no rows, and extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after a user or an assistant is put at a state, which is the one role that may follow there.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Kinds of rows: place of the initial in "sua" (3 for others), 4 more for truncated ones; rows that must go are GONE.
INITIALS, GONE = "sua", 8
#: Rows of one chunk.
CHUNK_ROWS = 256
SPACES = " \t\n\x0b\x0c\r"


def _after(q: int, kind: int) -> int | None:
    """The state after keeping a row of that kind, if it may be kept."""
    return {0: AFTER_S if q == START else None, 1: None if q == AFTER_U else AFTER_U, 2: AFTER_A if q == AFTER_U else None}.get(kind % 4)


def _options(q: int, kind: int, here: Callable[[int], float], then: tuple[int, ...]) -> dict[str, tuple[float, int]]:
    """Edits at a row from a state: letter to (cost to the end, state after it); `here` is the cost from a state before this row."""
    out = {"D": (DELETE + then[q], q), "I": (INSERT + here(NEXT[q]), NEXT[q])}
    if kind != GONE:
        more = TRUNCATED if kind >= 4 else 0
        if (kept := _after(q, kind)) is not None:
            out["K"] = (KEEP + more + then[kept], kept)
        out["R"] = (REROLE + more + then[NEXT[q]], NEXT[q])
    return out


def before(then: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Costs to the end before a row, from those after it; up to two inserts stand before the row."""
    row = [min(x for k, (x, _) in _options(q, kind, lambda _: 0, then).items() if k != "I") for q in range(4)]
    return tuple(min(row[q], INSERT + row[NEXT[q]], 2 * INSERT + row[NEXT[NEXT[q]]]) for q in range(4))


END_COSTS = (0, 2 * INSERT, INSERT, 0)


def _shapes() -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Shapes that can be met, the first that of a conversation's end, and the shape before a row of each kind."""
    known = {END_COSTS: 0}
    rows: list[list[int]] = []
    for shape in (todo := [END_COSTS]):
        rows.append([])
        for kind in range(GONE + 1):
            v = before(shape, kind)
            v = tuple(x - min(v) for x in v)
            if v not in known:
                known[v] = len(known)
                todo.append(v)
            rows[-1].append(known[v])
    return todo, np.array(rows).T.copy()


SHAPES, BEFORE = _shapes()
_BEFORE = BEFORE.tolist()


def _edits(shape: int, kind: int, q: int) -> tuple[str, int]:
    """The least letters at a row from a state, when the costs after it have that shape; and the state after it."""
    then = SHAPES[shape]
    here, letters = before(then, kind), ""
    while True:
        options = _options(q, kind, lambda s: here[s], then)
        letter = min(k for k, (x, _) in options.items() if x == here[q])
        letters, q = letters + letter, options[letter][1]
        if letter != "I":
            return letters, q


_EDITS = [[[_edits(s, k, q) for q in range(4)] for k in range(GONE + 1)] for s in range(len(SHAPES))]
#: Inserts at the end of a conversation, by state.
CLOSING = ("", "II", "I", "")


# -- one chunk -----------------------------------------------------------------------


def kinds_of(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[list[int], int, int, int]:
    """(kind of each row, blank, duplicate, truncated); `seen` holds the keys of earlier rows and gets those of these."""
    kinds, counts = [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        ink = text.rstrip(SPACES)
        if not ink:
            counts[0] += 1
            kinds.append(GONE)
            continue
        k = key(role, text)
        if k in seen:
            counts[1] += 1
            kinds.append(GONE)
            continue
        seen.add(k)
        cut = ink[-1] not in ".!?"
        counts[2] += cut
        kinds.append((INITIALS.find(role[:1]) if role[:1] in INITIALS and role else 3) + 4 * cut)
    return kinds, *counts


def key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def backward(kinds: list[int], end: int) -> list[int]:
    """Shapes after each row; the shape before the first row comes first."""
    out = [end]
    for kind in reversed(kinds):
        out.append(_BEFORE[kind][out[-1]])
    return out[::-1]


def rerun(shapes: list[int], kinds: list[int], end: int) -> list[int]:
    """The shapes from another end: rows are gone through backwards until what was there before is met."""
    out, at = list(shapes), len(shapes) - 1
    while at >= 0 and out[at] != end:
        out[at] = end
        at -= 1
        if at >= 0:
            end = _BEFORE[kinds[at]][end]
    return out


def entry_of(kinds: list[int]) -> list[int]:
    """The shape before a chunk for every shape after it."""
    out = np.arange(len(SHAPES))
    for k, kind in enumerate(reversed(kinds)):
        out = BEFORE[kind][out]
        if k % 16 == 15 and (out == out[0]).all():
            shape = int(out[0])
            for x in kinds[len(kinds) - k - 2 :: -1] if k + 1 < len(kinds) else ():
                shape = _BEFORE[x][shape]
            return [shape] * len(SHAPES)
    return out.tolist()


def trace(shapes: list[int], kinds: list[int], q: int) -> tuple[list[str], int]:
    """Letters of each row and the state after the last, from the shapes after each row (the first is before all)."""
    letters = []
    for k, kind in enumerate(kinds):
        some, q = _EDITS[shapes[k + 1]][kind][q]
        letters.append(some)
    return letters, q


def repaired(letters: list[str], roles: list[str], texts: list[str], q: int) -> list[str]:
    """Lines of the repaired chunk; letters beyond the rows are inserts at the end."""
    lines = []
    for k, some in enumerate(letters):
        for x in some:
            if x in "IR":
                q = NEXT[q]
                lines.append(("user:" if q == AFTER_U else "assistant:") + (texts[k] if x == "R" else ""))
            elif x == "K":
                q = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[roles[k][0]]
                lines.append(f"{roles[k]}:{texts[k]}")
    return lines


def cost_of(letters: list[str], kinds: list[int]) -> int:
    plain = "".join(letters)
    return DELETE * plain.count("D") + INSERT * plain.count("I") + REROLE * plain.count("R") + TRUNCATED * sum(kind in range(4, 8) and x[-1] != "D" for x, kind in zip(letters, kinds, strict=False))


def illegal_pairs(roles: list[str], last: str | None = None) -> int:
    firsts = ([] if last is None else [last]) + [x[:1] for x in roles]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))


@dataclass
class Turns:
    """Least, greatest and number of distinct turns of rows by rising turn, nulls first."""

    first: int | None = None
    last: int | None = None
    distinct: int = 0

    def add(self, first: int | None, last: int | None, distinct: int) -> None:
        if last is not None:
            self.distinct += distinct - (first == self.last)
            self.first, self.last = first if self.first is None else self.first, last

    def gaps(self) -> int:
        return 0 if self.last is None else self.last - self.first + 1 - self.distinct


def turns_of(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    real = [t for t in turns if t is not None]
    return (real[0], real[-1], len(set(real))) if real else (None, None, 0)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def finished(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
    """The result of a whole conversation."""
    kinds, *counts = kinds_of(roles, texts, set())
    letters, q = trace(backward(kinds, 0), kinds, START)
    letters.append(CLOSING[q])
    own = Turns()
    own.add(*turns_of(turns))
    text = "\n".join(repaired(letters, roles, texts, START))
    return (own.gaps(), *counts, illegal_pairs(roles), cost_of(letters, kinds), "".join(letters), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())


# -- tasks ---------------------------------------------------------------------------


@dataclass
class _Open:
    """Rows of the conversation that a task is reading."""

    name: tuple | None = None
    seq: int = 0
    turns: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Adds the damage: (conv_id, g, turn, role, text, times), where dropped rows have times 0 and no text."""
    one = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one(conv), F.lit(":"), one(turn)).cast("binary")) % 20
    df = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), fault.alias("fault"))
    group = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("k"), F.col("conv_id").cast("string")))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return df.select("conv_id", group.alias("g"), "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


def _read(kind: str) -> tuple[Callable, str]:
    """The task that finishes whole conversations and packs the chunks of the others, and its schema."""
    names = ["conv_id", "g", *RESULT, "part", "seq", "roles", "texts", "first", "last", "distinct", "keys"]
    kinds = [None, pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 3, pa.list_(pa.binary())]
    schema = f"conv_id {kind}, g string, {', '.join(f'{x} long' for x in RESULT[:6])}, audit string, repaired_sha256 string, part int, seq int, roles array<string>, texts array<string>, first long, last long, distinct long, keys array<binary>"

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, out, edge = TaskContext.get().partitionId(), _Open(), [], True

        def chunk() -> None:
            keys = list({key(a, b) for a, b in zip(own.roles, own.texts, strict=True) if b.strip(SPACES)})
            out.append((*own.name, *[None] * 8, part, own.seq, own.roles, own.texts, *turns_of(own.turns), keys))
            own.turns, own.roles, own.texts, own.seq = [], [], [], own.seq + 1

        def close(open_end: bool) -> None:
            if own.name is None:
                return
            if open_end or own.seq:
                chunk()
            else:
                out.append((*own.name, *finished(own.turns, own.roles, own.texts), *[None] * 8))

        for batch in batches:
            columns = batch.to_pydict()
            for conv, g, turn, role, text, times in zip(*columns.values(), strict=True):
                if own.name is None or own.name[1] != g:
                    close(edge)
                    edge = edge and own.name is None
                    own = _Open((conv, g))
                for _ in range(times):
                    own.turns.append(turn)
                    own.roles.append(role)
                    own.texts.append(text)
                    if len(own.roles) == CHUNK_ROWS:
                        chunk()
            yield _batch(out, names, kinds, batch.schema.field(0).type)
            out.clear()
        close(True)
        if out:
            yield _batch(out, names, kinds, batch.schema.field(0).type)

    return run, schema


def _batch(rows: list[tuple], names: list[str], kinds: list, first: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, k or first) for x, k in zip(columns, kinds, strict=True)], names)


@c.tidy
def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds of the rows, shapes from the speculative end, and the entry for every end."""
    for batch in batches:
        out = []
        for g, idx, roles, texts, seen in zip(*batch.to_pydict().values(), strict=True):
            kinds, *counts = kinds_of(roles, texts, set(seen or ()))
            out.append((g, idx, bytes(kinds), bytes(backward(kinds, 0)), entry_of(kinds), *counts))
        yield _batch(out, ["g", "idx", "kinds", "shapes", "f", "blank", "duplicate", "truncated"], [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), *[pa.int64()] * 3], None)


@c.tidy
def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes from the end that is known now, and the state after the chunk for every state before it."""
    for batch in batches:
        out = []
        for g, idx, kinds, shapes, end in zip(*batch.to_pydict().values(), strict=True):
            shapes, kinds = rerun(list(shapes), list(kinds), end), list(kinds)
            out.append((g, idx, bytes(kinds), bytes(shapes), [trace(shapes, kinds, q)[1] for q in range(4)]))
        yield _batch(out, ["g", "idx", "kinds", "shapes", "f"], [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32())], None)


@c.tidy
def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired lines of each chunk."""
    for batch in batches:
        out = []
        for g, idx, is_last, roles, texts, kinds, shapes, q in zip(*batch.to_pydict().values(), strict=True):
            letters, end = trace(list(shapes), list(kinds), q)
            letters += [CLOSING[end]] if is_last else []
            lines = repaired(letters, roles, texts, q)
            out.append((g, idx, cost_of(letters, list(kinds)), "".join(letters), "\n".join(lines), bool(lines), illegal_pairs(roles), roles[0][:1] if roles else None, roles[-1][:1] if roles else None))
        yield _batch(out, ["g", "idx", "cost", "audit", "lines", "any", "illegal", "first_initial", "last_initial"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()], None)


def _stitch(kind: str) -> tuple[Callable, str]:
    """Pieces by conversation and place to one row a conversation; a piece is held at a time, and the audit."""
    names = ["conv_id", *RESULT]

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, *[pa.int64()] * 6, pa.string(), pa.string()]

        def read() -> Iterator[dict]:
            for batch in batches:
                kinds[0] = batch.schema.field("conv_id").type
                yield from batch.to_pylist()

        for _, pieces in groupby(read(), lambda x: x["g"]):
            turns, counts, audit, digest, last, begun = Turns(), [0] * 5, [], hashlib.sha256(), None, False
            for x in pieces:
                turns.add(x["first"], x["last"], x["distinct"])
                counts = [a + x[k] for a, k in zip(counts, RESULT[1:6], strict=True)]
                if x["first_initial"] is not None:
                    counts[3] += last is not None and last + x["first_initial"] not in ("su", "ua", "au")
                    last = x["last_initial"]
                audit.append(x["audit"])
                if x["any"]:
                    digest.update((("\n" if begun else "") + x["lines"]).encode("utf-8", "surrogatepass"))
                    begun = True
            row = (x["conv_id"], turns.gaps(), *counts, "".join(audit), digest.hexdigest())
            yield _batch([row], names, kinds, None)

    return run, f"conv_id {kind}, {', '.join(f'{x} long' for x in RESULT[:6])}, audit string, repaired_sha256 string"


# -- joining of chunks ------------------------------------------------------------------


def settled(chunks: DataFrame, given: int) -> DataFrame:
    """(g, idx, value): f(f'(f''(... given))) of a chunk and all that follow it by idx; f are arrays of numbers.

    A function of one value settles what stands before it at once. The others are joined with what follows, twice as many
    chunks each time. What stays are rows of a few numbers.
    """
    one = F.size(F.array_distinct("f")) == 1
    state = chunks.select("g", "idx", "f", (F.col("idx") + 1).alias("to"), "chunks")
    while True:
        state = c.save(state.withColumn("open", ~one & (F.col("to") < F.col("chunks"))))
        if state.where("open").limit(1).count() == 0:
            return state.select("g", "idx", F.when(one, F.get("f", F.lit(0))).otherwise(F.get("f", F.lit(given))).alias("value"))
        more = state.select("g", F.col("idx").alias("to"), F.col("f").alias("f2"), F.col("to").alias("to2"))
        both = state.where("open").join(more, ["g", "to"])
        f = F.transform("f2", lambda x: F.get("f", x))
        state = both.select("g", "idx", f.alias("f"), F.col("to2").alias("to"), "chunks").union(state.where("not open").select("g", "idx", "f", "to", "chunks"))


def seen_before(chunks: DataFrame) -> DataFrame:
    """(g, idx, seen): keys of a chunk that an earlier chunk of the conversation has."""
    keys = chunks.select("g", "idx", F.explode("keys").alias("key"))
    first = keys.groupBy("g", "key").agg(F.min("idx").alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(first, ["g", "key"]).where("idx > at").groupBy("g", "idx").agg(F.collect_list("key").alias("seen"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation after its damage."""
    kind = dict(rows.dtypes)[conv]
    order = ["g", F.col("turn").asc_nulls_first(), "role", "_head", "_md5", "_row"]
    df = damaged(rows, conv, turn, role, text)
    df = df.withColumns({"_head": F.substring("text", 1, 64), "_md5": F.md5(F.col("text").cast("binary")), "_row": F.monotonically_increasing_id()})
    task, schema = _read(kind)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "g", "turn", "role", "text", "times")
    read = c.save(dealt.mapInArrow(task, schema))
    done = read.where("seq is null").select("conv_id", *RESULT)
    chunks = read.where("seq is not null")
    # a chunk's place: the chunks of earlier tasks' parts, then its number in its own
    parts = chunks.groupBy("g", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("g")
    parts = parts.select("g", "part", F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(own).alias("chunks"))
    placed = chunks.join(parts, ["g", "part"]).withColumn("idx", F.col("before") + F.col("seq"))
    placed = c.save(placed.select("g", "conv_id", "idx", "chunks", "roles", "texts", "first", "last", "distinct", "keys"))

    seen = placed.select("g", "idx", "roles", "texts").join(seen_before(placed), ["g", "idx"], "left")
    spec = c.save(seen.select("g", "idx", "roles", "texts", "seen").mapInArrow(_speculate, "g string, idx long, kinds binary, shapes binary, f array<int>, blank long, duplicate long, truncated long"))
    sizes = placed.select("g", "idx", "chunks")
    entries = settled(spec.select("g", "idx", "f").join(sizes, ["g", "idx"]), 0)
    ends = spec.join(entries.select("g", (F.col("idx") - 1).alias("idx"), "value"), ["g", "idx"], "left")
    fixed = c.save(ends.select("g", "idx", "kinds", "shapes", F.coalesce("value", F.lit(0)).alias("end")).mapInArrow(_fix_up, "g string, idx long, kinds binary, shapes binary, f array<int>"))

    # the same from the front: chunks are numbered from the last
    turned = fixed.select("g", "idx", "f").join(sizes, ["g", "idx"]).withColumn("idx", F.col("chunks") - 1 - F.col("idx"))
    states = settled(turned, START).join(sizes.select("g", "chunks").distinct(), "g").select("g", (F.col("chunks") - F.col("idx")).alias("idx"), F.col("value").alias("q"))
    ready = placed.join(fixed.drop("f"), ["g", "idx"]).join(states, ["g", "idx"], "left")
    ready = ready.select("g", "idx", (F.col("idx") == F.col("chunks") - 1).alias("is_last"), "roles", "texts", "kinds", "shapes", F.coalesce("q", F.lit(START)).alias("q"))
    pieces = ready.mapInArrow(_trace, "g string, idx long, cost long, audit string, lines string, any boolean, illegal long, first_initial string, last_initial string")
    pieces = pieces.join(spec.select("g", "idx", "blank", "duplicate", "truncated"), ["g", "idx"]).join(placed.select("g", "idx", "conv_id", "first", "last", "distinct"), ["g", "idx"])
    task, schema = _stitch(kind)
    stitched = pieces.repartition("g").sortWithinPartitions("g", "idx").mapInArrow(task, schema)
    return done.unionByName(stitched)
