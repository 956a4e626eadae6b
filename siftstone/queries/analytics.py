"""Queries over the analytics operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import cost
from .base import Tables, query

c = F.col


@query("""SELECT count(*)::BIGINT AS n, round(coalesce(avg(value), 0), 6) AS mean_value, count_if(event_type = 'click')::BIGINT AS up, count_if(event_type = 'error')::BIGINT AS down,
coalesce(round_even(count_if(event_type = 'click') / nullif(count_if(event_type IN ('click', 'error')), 0), 6), 0) AS helpful_rate FROM events""")
def overall_stats(t: Tables) -> DataFrame:
    up, down = F.count_if(c("event_type") == "click"), F.count_if(c("event_type") == "error")
    return t.events.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean_value"), up.alias("up"), down.alias("down"), A.rate(up, up + down).alias("helpful_rate"))


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(c("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT source, count_if(quality = 1)::BIGINT AS relevant, count_if(quality = 0)::BIGINT AS irrelevant, count_if(quality IS NULL)::BIGINT AS unrated, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def tristate_counts(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    q = c("quality")
    return df.groupBy("source").agg(F.count_if(q == 1).alias("relevant"), F.count_if(q == 0).alias("irrelevant"), F.count_if(q.isNull()).alias("unrated"), F.count("*").alias("n"))


@query("""SELECT event_type AS model, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_latency, round(avg(nullif(value, 0)), 6) AS mean_nonzero, round(sum(value), 4) AS total, count_if(user_id % 2 = 0)::BIGINT AS up, count_if(user_id % 3 = 0)::BIGINT AS down,
coalesce(round_even(count_if(user_id % 2 = 0) / nullif(count_if(user_id % 2 = 0) + count_if(user_id % 3 = 0), 0), 6), 0) AS helpful_rate FROM events GROUP BY 1""")
def per_group_performance(t: Tables) -> DataFrame:
    up, down = F.count_if(c("user_id") % 2 == 0), F.count_if(c("user_id") % 3 == 0)
    return t.events.groupBy(c("event_type").alias("model")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_latency"), F.round(F.avg(F.nullif("value", F.lit(0.0))), 6).alias("mean_nonzero"), F.round(F.sum("value"), 4).alias("total"), up.alias("up"), down.alias("down"), A.rate(up, up + down).alias("helpful_rate")
    )


@query("""WITH o AS (SELECT o_orderdate::DATE AS d, o_totalprice FROM orders), w AS (SELECT d + ((8 - isodow(d)) % 7)::INT AS week, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o GROUP BY 1),
s AS (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY))::DATE AS week FROM w) SELECT week, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0) AS total FROM s LEFT JOIN w USING (week)""")
def weekly_rollup_gapfilled(t: Tables) -> DataFrame:
    out = A.weekly(t.orders, "o_orderdate", {"n": F.lit(1), "total": c("o_totalprice")})
    return out.select("week", c("n").cast("long"), F.round("total", 2).alias("total"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, round(coalesce(stddev_samp(value), 0), 6) AS deviation,
max(CASE WHEN i = least(floor(0.5 * n), n - 1) THEN value END) AS p50, max(CASE WHEN i = least(floor(0.95 * n), n - 1) THEN value END) AS p95, max(CASE WHEN i = least(floor(0.99 * n), n - 1) THEN value END) AS p99 FROM r GROUP BY event_type""")
def latency_summary(t: Tables) -> DataFrame:
    return A.latency(t.events, "event_type", "value")


@query("""SELECT o_orderpriority AS server, count(*)::BIGINT AS chunks, count(DISTINCT o_orderkey)::BIGINT AS queries, count_if(l_returnflag = 'R')::BIGINT AS relevant, count_if(l_returnflag = 'A')::BIGINT AS irrelevant FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def joined_relevance(t: Tables) -> DataFrame:
    df = t.orders.where("o_orderstatus = 'F'").join(t.lineitem, c("o_orderkey") == c("l_orderkey"))
    flag = c("l_returnflag")
    return df.groupBy(c("o_orderpriority").alias("server")).agg(F.count("*").alias("chunks"), F.countDistinct("o_orderkey").alias("queries"), F.count_if(flag == "R").alias("relevant"), F.count_if(flag == "A").alias("irrelevant"))


@query("""WITH q AS (SELECT DISTINCT o_orderkey, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)
SELECT o_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM q JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1""")
def queries_with_relevant(t: Tables) -> DataFrame:
    """The 50 newest orders with a returned line, and those lines' parts, in one join."""
    hit = t.lineitem.where("l_returnflag = 'R'")
    newest = t.orders.join(hit, c("o_orderkey") == c("l_orderkey"), "left_semi").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return newest.join(hit, c("o_orderkey") == c("l_orderkey")).groupBy("o_orderkey").agg(F.array_join(parts, ",").alias("parts"))


@query("""SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click' AND props ILIKE '%"K": 1%' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40""")
def filtered_page(t: Tables) -> DataFrame:
    rows = A.filtered(t.events, {"event_type": "click"}, {"props": '"K": 1'}, ("ts", datetime(2024, 1, 5)), ("ts", datetime(2024, 1, 20)))
    return A.page(rows, [F.desc("ts"), c("event_id")], 2, 20).select("event_id", "user_id", "event_type", "value")


@query("""SELECT o_orderkey, sort_order::BIGINT AS sort_order, row_number() OVER (ORDER BY sort_order IS NULL DESC, sort_order, o_orderdate DESC, o_orderkey)::BIGINT AS place FROM (SELECT *, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 50 END AS sort_order FROM orders) ORDER BY place LIMIT 200""")
def nulls_first_order(t: Tables) -> DataFrame:
    df = t.orders.withColumn("sort_order", F.when(c("o_custkey") % 3 > 0, c("o_custkey") % 50).cast("long"))
    top = df.orderBy(c("sort_order").asc_nulls_first(), F.desc("o_orderdate"), "o_orderkey").limit(200)
    place = F.row_number().over(Window.orderBy(c("sort_order").asc_nulls_first(), F.desc("o_orderdate"), "o_orderkey"))
    return top.select("o_orderkey", "sort_order", place.cast("long").alias("place"))


@query("""SELECT o_orderkey, (SELECT max(p.o_orderdate) FROM orders p WHERE p.o_orderstatus = o.o_orderstatus AND p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS before, (SELECT min(p.o_orderdate) FROM orders p WHERE p.o_orderstatus = o.o_orderstatus AND p.o_custkey = o.o_custkey AND p.o_orderdate > o.o_orderdate) AS after FROM orders o""")
def adjacent_rows(t: Tables) -> DataFrame:
    return A.neighbours(t.orders, "o_orderkey", "o_orderdate", ["o_orderstatus", "o_custkey"])


@query("SELECT user_id, count_if(event_type = 'error')::BIGINT AS downvotes FROM events GROUP BY 1 HAVING count_if(event_type = 'error') > 0 ORDER BY 2 DESC, 1 LIMIT 50")
def top_downvoted(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_if(c("event_type") == "error").alias("downvotes")).where("downvotes > 0").orderBy(F.desc("downvotes"), "user_id").limit(50)


@query("SELECT user_id, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, user_id)::INT AS place FROM events GROUP BY 1")
def top_users(t: Tables) -> DataFrame:
    users = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return A.busiest(users, "user_id", "n")


@query("SELECT event_type AS server, max(ts) AS latest, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_server(t: Tables) -> DataFrame:
    return t.events.groupBy(c("event_type").alias("server")).agg(F.max("ts").alias("latest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""SELECT l_shipmode_stub AS part, count(*)::BIGINT AS n, round(avg(coalesce(l_tax, 0)) * 1000, 6) AS judge_ms, round(greatest(0, avg(l_quantity) - avg(l_tax) * 1000 - avg(l_discount) * 1000), 6) AS other_ms FROM (SELECT *, l_linenumber % 4 AS l_shipmode_stub FROM lineitem) GROUP BY 1""")
def latency_components(t: Tables) -> DataFrame:
    """Mean parts of a total, and what is left, not below 0."""
    m = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    other = F.greatest(F.lit(0.0), m("l_quantity") - m("l_tax") * 1000 - m("l_discount") * 1000)
    return t.lineitem.groupBy((c("l_linenumber") % 4).alias("part")).agg(F.count("*").alias("n"), F.round(m("l_tax") * 1000, 6).alias("judge_ms"), F.round(other, 6).alias("other_ms"))


#: Fixed: models with the prices of a thousand prompt and completion tokens, the share that a cached token costs, and whether the cache is priced apart.
BOOK = [("gpt-5", 0.00125, 0.01, 0.1, False), ("claude-sonnet-4-6", 0.003, 0.006, 0.1, True), ("deepseek-v4-pro", 0.000435, 0.00087, 0.1, False), ("glm-5", 0.0005, 0.0025, 1.0, False)]
CALLS = f"""book(model, prompt, completion, ratio, separate) AS (VALUES {", ".join("('%s', %r::DOUBLE, %r::DOUBLE, %r::DOUBLE, %s)" % x for x in BOOK)}),
calls AS (SELECT l_orderkey, l_linenumber, (l_quantity * 100)::BIGINT AS p, l_linenumber * 37 AS k, (l_quantity * 30)::BIGINT AS r, l_linenumber * 11 AS w, l_linestatus = 'O' AS batch, CASE WHEN l_returnflag = 'A' THEN 'x::m' ELSE 'openai' END AS backend,
CASE l_orderkey % 5 WHEN 0 THEN 'gpt-5#high' WHEN 1 THEN 'claude-sonnet-4-6' WHEN 2 THEN 'deepseek-v4-pro' WHEN 3 THEN 'glm-5#low' ELSE 'unknown' END AS m FROM lineitem),
pr AS (SELECT c.*, coalesce(prompt, 0.002::DOUBLE) AS pp, coalesce(completion, 0.002::DOUBLE) AS cc, coalesce(ratio, 1.0::DOUBLE) AS rr, coalesce(separate, false) AS sep FROM calls c LEFT JOIN book b ON split_part(c.m, '#', 1) = b.model),
pt AS (SELECT *, CASE WHEN sep THEN p / 1000 * pp ELSE (p - least(r, p)) / 1000 * pp END AS a, k / 1000 * cc AS b, CASE WHEN sep THEN r / 1000 * pp * 0.1::DOUBLE ELSE least(r, p) / 1000 * pp * rr END AS cr, CASE WHEN sep THEN w / 1000 * pp * 1.25::DOUBLE ELSE 0 END AS d,
CASE WHEN sep THEN r / 1000 * pp * 0.9::DOUBLE - w / 1000 * pp * 0.25::DOUBLE ELSE least(r, p) / 1000 * pp * (1 - rr) END AS save, CASE WHEN NOT batch THEN 0::DOUBLE WHEN backend = 'x::m' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS x FROM pr),
cost AS (SELECT *, (a + b + cr + d) * (1 - x) AS total, (a + b + cr + d) * x AS bsave FROM pt)"""


def _calls(t: Tables) -> DataFrame:
    k = c("l_orderkey") % 5
    model = F.when(k == 0, "gpt-5#high").when(k == 1, "claude-sonnet-4-6").when(k == 2, "deepseek-v4-pro").when(k == 3, "glm-5#low").otherwise("unknown")
    calls = t.lineitem.select("l_orderkey", "l_linenumber", (c("l_quantity") * 100).cast("long").alias("p"), (c("l_linenumber") * 37).alias("k"), (c("l_quantity") * 30).cast("long").alias("r"), (c("l_linenumber") * 11).alias("w"), (c("l_linestatus") == "O").alias("batch"), F.when(c("l_returnflag") == "A", "x::m").otherwise("openai").alias("backend"), model.alias("m"))
    book = t.lineitem.sparkSession.createDataFrame(BOOK, "model string, prompt double, completion double, ratio double, separate boolean")
    return cost.breakdown(cost.priced(calls, book, "m"), "p", "k", "r", "w", c("batch"), c("backend"))


@query(f"WITH {CALLS} SELECT l_orderkey, l_linenumber, m, round(a * (1 - x), 14) AS prompt_cost, round(b * (1 - x), 14) AS completion_cost, round(total, 14) AS total_cost, round(save, 14) AS cache_savings, round(bsave, 14) AS batch_savings FROM cost")
def llm_cost_model(t: Tables) -> DataFrame:
    r = lambda x: F.round(x, 14).alias(x)
    return _calls(t).select("l_orderkey", "l_linenumber", "m", r("prompt_cost"), r("completion_cost"), r("total_cost"), r("cache_savings"), r("batch_savings"))


@query(f"WITH {CALLS} SELECT split_part(m, '#', 1) AS model, batch, count(*)::BIGINT AS calls, round(sum(total), 4) AS total_cost, round(avg(total), 7) AS mean_cost, round(avg(CASE WHEN save <> 0 THEN save / (total + bsave + save) END), 6) AS saving_share FROM cost GROUP BY 1, 2")
def cost_rollup(t: Tables) -> DataFrame:
    gross = c("total_cost") + c("batch_savings") + c("cache_savings")
    return _calls(t).groupBy(F.split_part("m", F.lit("#"), F.lit(1)).alias("model"), "batch").agg(F.count("*").alias("calls"), F.round(F.sum("total_cost"), 4).alias("total_cost"), F.round(F.avg("total_cost"), 7).alias("mean_cost"), F.round(F.avg(F.when(c("cache_savings") != 0, c("cache_savings") / gross)), 6).alias("saving_share"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_suppkey END AS p, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_linenumber END AS k, l_partkey AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN p = 0 AND k = 0 THEN floor(total * 0.7::DOUBLE) ELSE p END::BIGINT AS prompt_tokens, CASE WHEN p = 0 AND k = 0 THEN floor(total * 0.3::DOUBLE) ELSE k END::BIGINT AS completion_tokens FROM h""")
def hop_token_split(t: Tables) -> DataFrame:
    odd = c("l_linenumber") % 2 == 0
    p, k = F.when(odd, 0).otherwise(c("l_suppkey")), F.when(odd, 0).otherwise(c("l_linenumber"))
    a, b = cost.hop_tokens(p, k, c("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", a.cast("long").alias("prompt_tokens"), b.cast("long").alias("completion_tokens"))


@query("SELECT l_suppkey, round(coalesce(stddev_pop(l_quantity), 0), 6) AS population, round(coalesce(stddev_samp(l_quantity), 0), 6) AS sample, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def population_vs_sample_std(t: Tables) -> DataFrame:
    r = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return t.lineitem.groupBy("l_suppkey").agg(r(F.stddev_pop("l_quantity")).alias("population"), r(F.stddev_samp("l_quantity")).alias("sample"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("""WITH r AS (SELECT l_suppkey AS test, l_linenumber AS run, avg(l_discount) AS m FROM lineitem GROUP BY ALL), t AS (SELECT test, avg(m) AS m, coalesce(stddev_samp(m), 0) AS s FROM r GROUP BY 1)
SELECT count(*)::BIGINT AS tests, round(avg(m), 6) AS mean_of_means, round(avg(s), 6) AS mean_of_deviations FROM t""")
def macro_of_runs(t: Tables) -> DataFrame:
    runs = t.lineitem.groupBy(c("l_suppkey").alias("test"), c("l_linenumber").alias("run")).agg(F.avg("l_discount").alias("m"))
    tests = runs.groupBy("test").agg(F.avg("m").alias("m"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("s"))
    return tests.agg(F.count("*").alias("tests"), F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.avg("s"), 6).alias("mean_of_deviations"))


@query("""WITH h AS (SELECT o_custkey % 500 AS q, o_orderkey % 4 AS hop, max((o_orderpriority = '1-URGENT')::INT) AS found FROM orders GROUP BY ALL), cu AS (SELECT q, hop, max(found) OVER (PARTITION BY q ORDER BY hop) AS have, (q + hop) % 2 = 0 AS judged FROM h)
SELECT count(*)::BIGINT AS n, count_if(have = 1 AND judged)::BIGINT AS tp, count_if(have = 0 AND judged)::BIGINT AS fp, count_if(have = 1 AND NOT judged)::BIGINT AS fn, round(count_if(have = 1 AND judged) / nullif(count_if(have = 1), 0), 6) AS recall, round(count_if(have = 1 AND judged) / nullif(count_if(judged), 0), 6) AS precision FROM cu""")
def hop_confusion(t: Tables) -> DataFrame:
    """Judged against what is found up to each hop."""
    h = t.orders.groupBy((c("o_custkey") % 500).alias("q"), (c("o_orderkey") % 4).alias("hop")).agg(F.max((c("o_orderpriority") == "1-URGENT").cast("int")).alias("found"))
    cu = h.select("q", "hop", (F.max("found").over(Window.partitionBy("q").orderBy("hop")) == 1).alias("have"), ((c("q") + c("hop")) % 2 == 0).alias("judged"))
    tp = F.count_if(c("have") & c("judged"))
    return cu.agg(F.count("*").alias("n"), tp.alias("tp"), F.count_if(~c("have") & c("judged")).alias("fp"), F.count_if(c("have") & ~c("judged")).alias("fn"), F.round(F.try_divide(tp, F.count_if("have")), 6).alias("recall"), F.round(F.try_divide(tp, F.count_if("judged")), 6).alias("precision"))


@query("""WITH m AS (SELECT l_returnflag AS metric, l_discount AS score FROM lineitem) SELECT metric, round(sum(CASE WHEN score >= 0.05 THEN score ELSE 0 END) / count(*), 6) AS earned, round(sum(CASE WHEN score < 0.05 THEN 0.05 - score ELSE 0 END) / count(*), 6) AS lost, round(coalesce(avg(CASE WHEN score > 1 THEN score END), 0.5), 6) AS fallback FROM m GROUP BY 1""")
def score_shares(t: Tables) -> DataFrame:
    s = c("l_discount")
    return t.lineitem.groupBy(c("l_returnflag").alias("metric")).agg(F.round(F.sum(F.when(s >= 0.05, s).otherwise(0.0)) / F.count("*"), 6).alias("earned"), F.round(F.sum(F.when(s < 0.05, 0.05 - s).otherwise(0.0)) / F.count("*"), 6).alias("lost"), F.round(F.coalesce(F.avg(F.when(s > 1, s)), F.lit(0.5)), 6).alias("fallback"))


@query("""PIVOT (SELECT p_size % 5 AS a, p_size % 3 AS b, p_retailprice FROM part) ON b IN (0, 1, 2) USING round(avg(p_retailprice), 4) GROUP BY a""")
def sweep_heatmap(t: Tables) -> DataFrame:
    df = t.part.select((c("p_size") % 5).alias("a"), (c("p_size") % 3).alias("b"), "p_retailprice")
    return df.groupBy("a").pivot("b", [0, 1, 2]).agg(F.round(F.avg("p_retailprice"), 4))


@query("""WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN s.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN s.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM s FULL JOIN n USING (doc_id)""")
def incremental_classify(t: Tables) -> DataFrame:
    """A stored snapshot against a later one, made by rule from the same table."""
    from ..sources.tables import classify

    d = t.documents
    old = d.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(c("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(c("text")), 256).alias("hash"))
    return classify(old, new, "doc_id", "hash")


@query("""SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'edited' ELSE source END AS source, n_chars FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id + 1000000, 'added', n_chars FROM documents WHERE doc_id % 5 = 0)""")
def table_upsert_delete(t: Tables) -> DataFrame:
    """Rows upserted by id, then every third original one deleted."""
    from ..sources.tables import deleted, upserted

    d = t.documents.select("doc_id", "source", "n_chars")
    fifth = d.where("doc_id % 5 = 0")
    rows = fifth.withColumn("source", F.lit("edited")).union(fifth.select(c("doc_id") + 1_000_000, F.lit("added"), "n_chars"))
    return deleted(upserted(d, rows, "doc_id"), d.where("doc_id % 3 = 0").select("doc_id"), "doc_id")


@query("""WITH u AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS seg, arg_max(o_totalprice, o_orderkey) AS bal FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(bal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN u USING (c_custkey)""")
def latest_wins_overlay(t: Tables) -> DataFrame:
    """Customers with the latest of their orders' values laid over."""
    updates = t.orders.select(c("o_custkey").alias("c_custkey"), "o_orderkey", F.when(c("o_orderstatus") == "O", c("o_orderpriority")).alias("c_mktsegment"), c("o_totalprice").alias("c_acctbal"))
    return A.overlay(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), updates, "c_custkey", "o_orderkey")


@query("""SELECT event_type, count_if(ts < TIMESTAMP '2024-02-01' - INTERVAL 30 DAY)::BIGINT AS analytics_gone, count_if(ts < TIMESTAMP '2024-02-01' - INTERVAL 7 DAY)::BIGINT AS personal_gone, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def retention_partition(t: Tables) -> DataFrame:
    now = datetime(2024, 2, 1)
    return t.events.groupBy("event_type").agg(F.count_if(A.expired(None, "ts", now, 30)).alias("analytics_gone"), F.count_if(A.expired(None, "ts", now, 7)).alias("personal_gone"), F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01') GROUP BY 1")
def cascade_delete(t: Tables) -> DataFrame:
    """Lines that are left when the orders before 1996 go."""
    _, lines = A.cascade_delete(t.orders, t.lineitem, c("o_orderdate") < datetime(1996, 1, 1), "o_orderkey", "l_orderkey")
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_messages(t: Tables) -> DataFrame:
    return A.last_messages(t.conversations, "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def conversation_sessions(t: Tables) -> DataFrame:
    return A.sessions(t.events, "user_id", "ts").select("user_id", "begin", "end", "n")


@query("""WITH v AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'up' ELSE 'down' END AS vote, event_id % 40 AS target FROM events WHERE event_type IN ('click', 'purchase')), l AS (SELECT *, lag(vote) OVER (PARTITION BY target, user_id ORDER BY ts, event_id) AS undone FROM v)
SELECT event_id, user_id, target, vote, undone FROM l WHERE undone IS NULL OR undone <> vote""")
def vote_transitions(t: Tables) -> DataFrame:
    v = t.events.where("event_type in ('click', 'purchase')").select("user_id", "event_id", "ts", F.when(c("event_type") == "click", "up").otherwise("down").alias("vote"), (c("event_id") % 40).alias("target"))
    return A.vote_changes(v, "target", "user_id", "vote", ["ts", "event_id"]).select("event_id", "user_id", "target", "vote", "undone")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT user_id, event_id, TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 20000) AS ts FROM events)),
f(user_id, event_id, t, n, allowed, tokens, retry) AS (SELECT user_id, event_id, t, n, true, 9.0::DOUBLE, 0.0::DOUBLE FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.event_id, e.t, e.n, x >= 1, CASE WHEN x >= 1 THEN x - 1 ELSE x END, CASE WHEN x >= 1 THEN 0 ELSE (1 - x) / (10.0::DOUBLE / 60) END FROM (SELECT e.*, least(15.0::DOUBLE, f.tokens + (e.t - f.t) * (10.0::DOUBLE / 60)) AS x FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) e)
SELECT user_id, count(*)::BIGINT AS n, count_if(allowed)::BIGINT AS allowed, round(sum(tokens), 3) AS tokens, round(max(retry), 3) AS retry FROM f GROUP BY user_id""")
def token_bucket_trace(t: Tables) -> DataFrame:
    """Events of a month pressed into minutes, under the rate limit of each user."""
    base = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    pressed = F.timestamp_micros(F.unix_micros(base) + F.floor((F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(base)) / 20000).cast("long"))
    trace = A.token_bucket(t.events.select("user_id", "event_id", pressed.alias("at")), "user_id", "at", "event_id")
    return trace.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"), F.round(F.sum("tokens"), 3).alias("tokens"), F.round(F.max("retry_after"), 3).alias("retry"))
