"""Queries over the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .base import Tables, query

c = F.col


@query("""WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS hop FROM lineitem GROUP BY ALL), p AS (SELECT hop, count(*) AS gained FROM f GROUP BY 1)
SELECT hop, sum(gained) OVER (ORDER BY hop)::BIGINT AS truths, gained::BIGINT AS gained FROM p""")
def hits_by_hop(t: Tables) -> DataFrame:
    return E.hits_by_hop(t.lineitem, "l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT max(CASE WHEN r > 0 THEN r END)::BIGINT AS most, round(avg(CASE WHEN r > 0 THEN r END), 6) AS mean, count(CASE WHEN r > 0 THEN r END)::BIGINT AS found, (count(*) - count(CASE WHEN r > 0 THEN r END))::BIGINT AS missing FROM (SELECT o_custkey % 30 - 5 AS r FROM orders)")
def rank_summary(t: Tables) -> DataFrame:
    return E.rank_summary(t.orders.select((c("o_custkey") % 30 - 5).alias("r")), "r")


@query("SELECT o_custkey, count(*)::BIGINT AS runs, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY 1")
def pass_rates(t: Tables) -> DataFrame:
    return E.pass_rates(t.orders, "o_custkey", c("o_orderstatus") == "F")


@query("SELECT l_partkey, count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def missing_counts(t: Tables) -> DataFrame:
    return E.missing_counts(t.lineitem.where("l_returnflag = 'R'"), "l_partkey")


@query("SELECT p_partkey, 'mc' || p_size || '_mr' || printf('%.2f', p_retailprice) AS config, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def best_configuration(t: Tables) -> DataFrame:
    key = E.configuration_key({"mc": ("%d", "p_size"), "mr": ("%.2f", "p_retailprice")})
    return E.best_configuration(t.part.select("p_partkey", key.alias("config"), "p_retailprice"), "p_retailprice", "p_partkey")


@query("SELECT l_orderkey, round(coalesce(avg(exp(-l_discount)) FILTER (WHERE l_returnflag <> 'N'), 0.7), 6) AS confidence FROM lineitem GROUP BY 1")
def answer_confidence(t: Tables) -> DataFrame:
    logs = F.collect_list(F.when(c("l_returnflag") != "N", -c("l_discount")))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(E.confidence(logs), 6).alias("confidence"))


@query("""WITH v AS (SELECT event_id, event_id % 25 AS target, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS d FROM events), s AS (SELECT *, sum(d) OVER (PARTITION BY target ORDER BY event_id) AS s FROM v),
m AS (SELECT *, least(0, min(s) OVER (PARTITION BY target ORDER BY event_id)) AS low FROM s) SELECT target, arg_max(s - low, event_id)::BIGINT AS count FROM m GROUP BY 1""")
def clamped_vote_counts(t: Tables) -> DataFrame:
    from ..operators.invariants import clamped_votes

    v = t.events.select("event_id", (c("event_id") % 25).alias("target"), F.when(c("event_type").isin("click", "view"), 1).otherwise(-1).alias("d"))
    return clamped_votes(v, "target", "event_id", "d")


ERRORS = ["HTTP 401", "Rate limit on a bad Schema", "request canceled", "Safety: refused", "timed out", "insufficient_quota", "an unsupported thing", "blocked by 503"]


@query(f"""WITH m(i, x) AS (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(ERRORS))}) SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 2, 3, 7) THEN 'permanent' ELSE 'transient' END AS class,
['401', 'schema', 'canceled', 'safety', 'timed out', 'insufficient_quota', 'unclassified', 'blocked'][1 + event_id % 8] AS reason FROM events JOIN m ON i = event_id % 8""")
def error_classes(t: Tables) -> DataFrame:
    from ..operators.invariants import error_class, error_reason

    text = F.get(F.array(*map(F.lit, ERRORS)), (c("event_id") % 8).cast("int"))
    return t.events.select("event_id", error_class(text).alias("class"), error_reason(text).alias("reason"))


@query("""SELECT o_orderkey, CASE WHEN e IS NULL AND k IS NULL THEN 'retry' WHEN e IS NULL THEN 'succeeded' WHEN e = 'timeout' THEN 'retry' ELSE 'failed' END AS state FROM orders LEFT JOIN (SELECT o_orderkey AS k, CASE o_custkey % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'invalid_request' END AS e FROM orders WHERE o_orderkey % 6 <> 0) ON o_orderkey = k""")
def batch_states(t: Tables) -> DataFrame:
    from ..operators.invariants import batch_results

    m = c("o_custkey") % 4
    results = t.orders.where("o_orderkey % 6 <> 0").select("o_orderkey", F.when(m == 0, "timeout").when(m == 1, "invalid_request").alias("e"))
    return batch_results(t.orders.select("o_orderkey"), results, "o_orderkey", "e")


@query("""SELECT o_orderkey, o_totalprice / 500000 >= 0.3 AND o_custkey % 10 / 10 >= 0.6 AS ok, CASE WHEN o_totalprice / 500000 < 0.3 AND o_custkey % 10 / 10 < 0.6 THEN 'confidence and relevance' WHEN o_totalprice / 500000 < 0.3 THEN 'confidence' WHEN o_custkey % 10 / 10 < 0.6 THEN 'relevance' END AS why FROM orders""")
def answer_gate(t: Tables) -> DataFrame:
    from ..operators.invariants import accepted

    ok, why = accepted(c("o_totalprice") / 500000, c("o_custkey") % 10 / 10, 0.3, 0.6)
    return t.orders.select("o_orderkey", ok.alias("ok"), why.alias("why"))


RESULTS = {
    "model": "l_returnflag", "test": "l_linenumber % 5", "score": "l_quantity * 2", "seconds": "l_linenumber * 1.5e0", "cost": "l_extendedprice / 1e6", "cache_savings": "l_tax / 10", "multi_hop": "l_tax / 100", "judge": "l_discount / 100",
    "embedding": "l_linenumber * 1e-4", "batch_savings": "l_discount / 1000", "total_cost": "l_extendedprice / 1e6 + l_tax / 100", "quote_recall": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 10 END", "quote_precision": "l_tax * 10",
    "quote_faithfulness": "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax * 5 END", "explanation_faithfulness": "CASE WHEN l_linenumber = 5 THEN NULL ELSE 0.5e0 END", "answer_correctness": "l_quantity / 50",
}
_SPREAD = ", ".join(f"round(avg({x}), 6) AS avg_{x}, round(coalesce(stddev_pop({x}), 0), 6) AS std_dev_{x}" for x in E.SPREAD)
_MEANS = ", ".join(f"round(avg({x}), 6) AS avg_{x}" for x in E.MEANS)


@query(f"""WITH r AS (SELECT {", ".join(f"({v}){'' if k in ('model', 'test') else '::DOUBLE'} AS {k}" for k, v in RESULTS.items())} FROM lineitem), g AS (SELECT *, cost + cache_savings AS gross_cost FROM r)
SELECT model, test::INT AS test, count(*)::BIGINT AS results, {_SPREAD}, {_MEANS}, round(coalesce(avg(cache_savings) / nullif(avg(gross_cost), 0) * 100, 0), 6) AS avg_cache_savings_pct, round(avg(multi_hop) + avg(judge) + avg(embedding), 6) AS avg_infrastructure FROM g GROUP BY GROUPING SETS ((model), (test))""")
def result_summaries(t: Tables) -> DataFrame:
    """Line items as results of models and tests."""
    rows = t.lineitem.select(*((F.expr(v) if k in ("model", "test") else F.expr(f"({v})").cast("double")).alias(k) for k, v in RESULTS.items()))
    return E.summaries(rows.withColumn("test", F.col("test").cast("int")), ["model", "test"])
