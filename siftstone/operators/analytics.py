"""Roll-ups of a query log, latest-wins overlays and keyed folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import placed


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, 0 where the whole is 0, rounded half to even."""
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


def weekly(rows: DataFrame, ts: str, measures: dict[str, Column]) -> DataFrame:
    """Sums by week, a week being Tuesday to Monday and named by its Monday; empty weeks are there with 0."""
    week = F.next_day(F.date_sub(F.to_date(ts), 1), "MON")
    sums = rows.groupBy(week.alias("week")).agg(*(F.sum(c).alias(k) for k, c in measures.items()))
    spine = sums.agg(F.min("week").alias("a"), F.max("week").alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("week"))
    return spine.join(sums, "week", "left").select("week", *(F.coalesce(k, F.lit(0)).alias(k) for k in measures))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, extremes, sample deviation, and percentiles by index: the value at min(floor(p n), n - 1).

    Equal values are counted first; each knows how many values stand before it, so the values at given
    places are found without gathering or sorting a key's rows in one task.
    """
    known = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    plain = known.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("_v"), 6).alias("mean"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.round(F.coalesce(F.stddev_samp("_v"), F.lit(0.0)), 6).alias("deviation"))
    counted = placed(known.groupBy(key, "_v").agg(F.count("*").alias("_k")), [key], "_v", F.col("_k"))
    both = counted.join(plain.select(key, "n"), key)
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("_k")), F.col("_v")))
    index = lambda p: F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    found = both.groupBy(key).agg(F.round(middle, 6).alias("median"), at(index(0.5)).alias("p50"), at(index(0.95)).alias("p95"), at(index(0.99)).alias("p99"))
    return plain.join(found, key).select(key, "n", "mean", "median", "least", "most", "deviation", "p50", "p95", "p99")


def busiest(counts: DataFrame, user: str, n: str) -> DataFrame:
    """Adds `place`: by falling count, then by user, without a window over all users."""
    sizes = placed(counts.groupBy(n).agg(F.count("*").alias("_k")).withColumn("_one", F.lit(1)).withColumn("_down", -F.col(n)), ["_one"], "_down", F.col("_k")).select(n, F.col("before").alias("_more"))
    inside = placed(counts, [n], user, F.lit(1))
    return inside.join(sizes, n).withColumn("place", (F.col("_more") + F.col("before") + 1).cast("int")).drop("_more", "before")


def overlay(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Base rows with the latest non-null value of each updated column."""
    names = [x for x in updates.columns if x in base.columns and x != key]
    last = updates.groupBy(key).agg(*(F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias(f"_{x}") for x in names))
    return base.join(last, key, "left").select(*(F.coalesce(f"_{x}", x).alias(x) if x in names else F.col(x) for x in base.columns))


def filtered(rows: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str] | None = None, since: tuple[str, object] | None = None, until: tuple[str, object] | None = None) -> DataFrame:
    """Rows that meet all conditions given; `like` is a case-blind substring in which % and _ stay wild."""
    parts = [F.col(k) == v for k, v in (equal or {}).items()] + [F.col(k).ilike(f"%{v}%") for k, v in (like or {}).items()]
    parts += [F.col(since[0]) >= since[1]] if since else []
    parts += [F.col(until[0]) <= until[1]] if until else []
    return rows.where(reduce(lambda a, b: a & b, parts)) if parts else rows


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def neighbours(rows: DataFrame, key: str, ts: str, parts: list[str]) -> DataFrame:
    """(key, before, after): the nearest other times within the parts, strictly earlier and later."""
    times = rows.select(*parts, ts).distinct()
    w = Window.partitionBy(*parts).orderBy(ts)
    near = times.select(*parts, ts, F.lag(ts).over(w).alias("before"), F.lead(ts).over(w).alias("after"))
    return rows.join(near, [*parts, ts]).select(key, "before", "after")


def expired(rows: DataFrame, ts: str, now, days: int) -> Column:
    return F.col(ts) < F.lit(now) - F.expr(f"interval {days} days")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: Column, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the deleted parents; children never outlive theirs."""
    ids = parents.where(gone).select(F.col(key).alias("_gone"))
    return parents.where(~gone), children.join(ids, F.col(child_key) == F.col("_gone"), "left_anti")


# -- folds over one key's events in order ----------------------------------------------------

LIMIT, WINDOW_SECONDS, BURST = 10.0, 60.0, 15.0


def token_bucket(events: DataFrame, key: str, ts: str, event_id: str, limit: float = LIMIT, window: float = WINDOW_SECONDS, burst: float = BURST) -> DataFrame:
    """(key, event id, allowed, tokens, retry_after) of each event under a token bucket for its key.

    A bucket starts with `limit` tokens, gains limit / window a second up to `burst`, and an event takes one.
    A key's events come sorted in one task, which reads them batch by batch and carries two numbers over.
    """
    import pandas as pd

    fill = limit / window

    def run(batches):
        now, tokens, last = None, limit, None
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                if last is None or k != now:
                    now, tokens = k, limit
                else:
                    tokens = min(burst, tokens + (t - last) * fill)
                last = t
                if tokens >= 1.0:
                    tokens -= 1.0
                    out.append((True, tokens, 0.0))
                else:
                    out.append((False, tokens, (1.0 - tokens) / fill))
            yield pd.DataFrame({"k": pdf["k"], "e": pdf["e"], "allowed": [x[0] for x in out], "tokens": [x[1] for x in out], "retry_after": [x[2] for x in out]})

    rows = events.select(F.col(key).alias("k"), F.col(event_id).alias("e"), F.col(ts).cast("timestamp").cast("double").alias("t"))
    kinds = dict(rows.dtypes)
    out = rows.repartition("k").sortWithinPartitions("k", "t", "e").mapInPandas(run, f"k {kinds['k']}, e {kinds['e']}, allowed boolean, tokens double, retry_after double")
    return out.select(F.col("k").alias(key), F.col("e").alias(event_id), "allowed", F.round("tokens", 6).alias("tokens"), F.round("retry_after", 6).alias("retry_after"))


def vote_changes(votes: DataFrame, target: str, user: str, vote: str, order: list[str]) -> DataFrame:
    """Adds `change`: +1 for a first vote or a changed one, with `undone` naming the vote it replaces; repeats are dropped."""
    w = Window.partitionBy(target, user).orderBy(*order)
    return votes.withColumn("undone", F.lag(vote).over(w)).where(F.col("undone").isNull() | (F.col("undone") != F.col(vote)))


def last_messages(messages: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sessions(rows: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    s = F.session_window(F.col(ts).cast("timestamp"), gap)
    return rows.groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")
