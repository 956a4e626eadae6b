"""Queries over written reports that are read back, and over summaries of cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cost, evaluation, summaries
from ..sources import reports
from ..sources.scratch import folder
from .analytics import BOOK, CALLS, _calls
from .base import Tables, query

c, md5 = F.col, F.md5

#: Texts as one line without white space at its ends, and without marks of markdown: what both forms of an answer can carry.
LINE = r"trim(regexp_replace(replace(replace(coalesce(text, ''), '*', '.'), '---', '-'), '[\x00-\x20\x7f-\xa0  -     　]+', ' ', 'g'))"
PROVIDERS = {"claude-sonnet-4-6": "claude", "gpt-5": "chatgpt"}


def _line(text):
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("*"), F.lit(".")), F.lit("---"), F.lit("-"))
    return F.trim(F.regexp_replace(plain, r"[\x00-\x20\x7f-\xa0  -     　]+", " "))


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 12 AS k, lang, source, {LINE} AS x FROM documents),
q AS (SELECT *, CASE WHEN x = '' THEN 0 ELSE 1 END AS n, CASE k WHEN 3 THEN 'metadata' WHEN 4 THEN 'metadata:json' WHEN 5 THEN 'metadata:costs' WHEN 6 THEN 'metadata:tokens.total' WHEN 7 THEN 'query' END AS fault FROM d)
SELECT doc_id, fault, CASE WHEN fault IS NULL THEN 'asked ' || doc_id END AS query, CASE WHEN fault IS NULL THEN k < 3 END AS stored,
CASE WHEN fault IS NULL THEN CASE WHEN k < 3 THEN 'short' ELSE 'short ' || doc_id END END AS short_answer, CASE WHEN fault IS NULL THEN n END AS quotes,
CASE WHEN fault IS NULL AND n > 0 AND k >= 3 THEN right(md5(x || chr(10) || 'end'), 8) END AS chunk_id, CASE WHEN fault IS NULL AND n > 0 THEN md5(x || chr(10) || 'end') END AS quote,
CASE WHEN fault IS NULL AND k >= 3 THEN md5('why ' || doc_id || ' ' || x) END AS explanation, CASE WHEN fault IS NULL AND k >= 3 THEN CASE WHEN k = 8 THEN '' ELSE 'bye ' || doc_id END END AS afterword,
CASE WHEN fault IS NULL THEN doc_id % 100 * 10 END::BIGINT AS latency_ms, CASE WHEN fault IS NULL THEN CASE k % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'chatgpt' ELSE 'unknown' END END AS provider, CASE WHEN fault IS NULL THEN n > 0 END AS has_quotes FROM q""")
def saved_answers(t: Tables) -> DataFrame:
    """Documents as saved answers, written, read back and taken apart; some carry their JSON, some have faulty data."""
    i, k, x, s = c("doc_id"), c("doc_id") % 12, c("x"), lambda v: v.cast("string")
    rows = t.documents.select("doc_id", _line(c("text")).alias("x"))
    quote = F.struct(F.lit("Title").alias("quote_title"), F.concat(x, F.lit("\nend")).alias("quote_text"))
    quotes = F.when(x == "", F.array().cast("array<struct<quote_title:string,quote_text:string>>")).otherwise(F.array(quote))
    stored = F.when(k < 3, F.to_json(F.struct(F.lit("short").alias("short_answer"), quotes.alias("quotes"))))
    model = F.when(k % 3 == 0, "claude-sonnet-4-6").when(k % 3 == 1, "gpt-5").otherwise("other")
    parts = {
        "test_metadata": F.struct(s(i).alias("test_id"), model.alias("actual_model_id")), "costs": F.when(k != 5, F.struct(F.lit(0.5).alias("total"))), "latency": F.struct((i % 100 / 100).alias("llm_generation_seconds")),
        "tokens": F.struct(F.lit(3).alias("prompt"), F.lit(4).alias("completion"), F.when(k != 6, 7).alias("total")), "deterministic_metrics": F.struct(F.lit(1.0).alias("quote_recall")), "response_json": stored,
    }
    data = F.when(k == 4, "{").when(k != 3, F.to_json(F.struct(*(v.alias(n) for n, v in parts.items()))))
    after = F.when(k == 8, F.concat(F.lit("**"), F.repeat(F.lit("long "), 30), F.lit("**"))).otherwise(F.concat(F.lit("bye "), s(i)))
    text = reports.answer_text(F.concat(F.lit("asked "), s(i)), F.concat(F.lit("short "), s(i)), quotes, F.concat(F.lit("why "), s(i), F.lit(" "), x), after, data)
    text = F.concat(F.lit("id "), s(i), F.lit("\n"), F.when(k == 7, F.replace(text, F.lit("# Query"), F.lit("# Asked"))).otherwise(text))
    place = folder(t._spark, "answers")
    reports.write_answers(rows.select(text.alias("value")), place)
    back = reports.answer_files(t._spark, place, whole=False)
    read = reports.read_answers(back.select(F.regexp_extract("text", r"\Aid (\d+)", 1).cast("long").alias("doc_id"), "text"), "text", PROVIDERS)
    shape = "short_answer string, quotes array<struct<quote_title: string, quote_text: string, chunk_id: string>>, explanation string, persona_afterword string, smalltalk boolean"
    a = read.withColumn("a", F.from_json("answer", shape))
    first = F.get("a.quotes", F.lit(0))
    return a.select(
        "doc_id", "fault", "query", F.when(c("fault").isNull(), c("a.smalltalk").isNull()).alias("stored"), "a.short_answer", F.when(c("fault").isNull(), F.size("a.quotes")).alias("quotes"), first["chunk_id"].alias("chunk_id"), md5(first["quote_text"]).alias("quote"),
        md5("a.explanation").alias("explanation"), c("a.persona_afterword").alias("afterword"), "call.latency_ms", "call.provider", "call.has_quotes",
    )


@query("""WITH g AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(text, '')), role) AS place FROM conversations)
SELECT test_id, count(*)::BIGINT AS runs, count(*) FILTER (WHERE NOT missing)::BIGINT AS passed, count(*) FILTER (WHERE missing)::BIGINT AS failed, round(count(*) FILTER (WHERE NOT missing) / count(*) * 100, 6) AS pass_rate
FROM (SELECT 'turn-' || coalesce(turn, 0) AS test_id, (conv_id + coalesce(turn, 0)) % 3 = 0 AS missing FROM g WHERE place > 1 AND conv_id % 7 <> 0) GROUP BY 1""")
def report_test_rates(t: Tables) -> DataFrame:
    """Conversations as reports of runs with their turns as tests; every seventh has no such section, and a section's first test stands right behind its title."""
    turn = F.coalesce("turn", F.lit(0))
    part = F.concat(F.lit("\n### turn-"), turn.cast("string"), F.lit("\n"), F.when((c("conv_id") + turn) % 3 == 0, "**Missing** ❌").otherwise("**Found**"), F.lit("\n"))
    item = F.struct("turn", md5(F.coalesce("text", F.lit(""))), "role", part.alias("p"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["p"]), "")
    title = F.when(c("conv_id") % 7 == 0, "## Other").otherwise("## Per-Test Results")
    g = t.conversations.groupBy("conv_id").agg(body.alias("body")).select("conv_id", F.concat(F.lit("# Report\n\n"), title, F.lit("\n"), "body").alias("report"))
    return reports.test_rates(reports.test_results(g, "conv_id", "report")).withColumn("pass_rate", F.round("pass_rate", 6))


@query("""SELECT p_size::DOUBLE AS max_chunks, NULL::DOUBLE AS min_relevance, round(avg(p_retailprice), 4) AS mean_context_precision, round(min(p_retailprice), 4) AS mean_context_recall, count(*)::DOUBLE AS total_cost_usd FROM part GROUP BY p_size
UNION ALL SELECT p_size, p_partkey % 5, round(avg(p_retailprice), 4), round(min(p_retailprice), 4), count(*) FROM part GROUP BY p_size, p_partkey % 5""")
def sweep_files(t: Tables) -> DataFrame:
    """Parts as results of a sweep over one parameter and of a grid of two, written and read back."""
    agg = {"mean_context_precision": F.round(F.avg("p_retailprice"), 4), "mean_context_recall": F.round(F.min("p_retailprice"), 4), "total_cost_usd": F.count("*"), **{x: F.lit(1) for x in ("std_dev_context_precision", "std_dev_context_recall", "total_time_seconds", "avg_retrieval_time_seconds")}}
    shown = [*(c(x) for x in ("mean_context_precision", "mean_context_recall", "total_cost_usd"))]
    out = []
    for params in (["max_chunks"], ["max_chunks", "min_relevance"]):
        keys = [c("p_size").alias("max_chunks"), (c("p_partkey") % 5).alias("min_relevance")][: len(params)]
        place = folder(t._spark, "sweep")
        reports.write_sweep(t.part.groupBy(*keys).agg(*(v.alias(k) for k, v in agg.items())), params, place)
        second = c("min_relevance") if len(params) > 1 else F.lit(None).cast("double")
        out.append(reports.read_sweep(t._spark, params, place).select("max_chunks", second.alias("min_relevance"), *shown))
    return out[0].unionByName(out[1])


@query("""WITH a AS (SELECT DISTINCT p_type AS w FROM part), b AS (SELECT DISTINCT w FROM (SELECT p_brand AS w FROM part UNION ALL SELECT p_type FROM part))
SELECT w AS keyword, (SELECT count(*) FROM a)::BIGINT AS first_added, (SELECT count(*) FROM b WHERE w NOT IN (SELECT w FROM a))::BIGINT AS then_added FROM b""")
def keyword_file(t: Tables) -> DataFrame:
    """Types of parts as keywords in a file, then types and brands; the file is read back with how many words each run has added."""
    place = folder(t._spark, "keywords")
    first = reports.add_keywords(t._spark, place, t.part.select("p_type"))
    then = reports.add_keywords(t._spark, place, t.part.select("p_type").union(t.part.select("p_brand")))
    return reports.keywords(t._spark, place).select("keyword", F.lit(first).cast("long").alias("first_added"), F.lit(then).cast("long").alias("then_added"))


# -- cost ------------------------------------------------------------------------------------


@query(f"""WITH {CALLS}, s AS (SELECT m, count(*)::BIGINT AS calls, sum(total) AS a, sum(save) AS b, sum(bsave) AS d FROM cost WHERE batch GROUP BY 1)
SELECT m, calls, round(a, 6) AS total_cost, round(b, 6) AS cache_savings, round(d, 6) AS batch_savings, round(CASE WHEN a + b + d > 0 THEN b / (a + b + d) * 100 ELSE 0 END, 6) AS cache_share, round(CASE WHEN a + b + d > 0 THEN d / (a + b + d) * 100 ELSE 0 END, 6) AS batch_share FROM s""")
def batch_cost_totals(t: Tables) -> DataFrame:
    out = summaries.batch_totals(_calls(t).where("batch"), "m")
    return out.select("m", "calls", *(F.round(x, 6).alias(x) for x in ("total_cost", "cache_savings", "batch_savings", "cache_share", "batch_share")))


ALIASES = {"claude-4.6-sonnet": "claude-sonnet-4-6", "gpt-5-latest": "gpt-5"}
RATES = {"gpt-5": BOOK[0], "claude-sonnet-4-6": BOOK[1], "glm-5": BOOK[3]}


@query(f"""WITH book(model, prompt, completion, ratio, separate) AS (VALUES {", ".join("('%s', %r::DOUBLE, %r::DOUBLE, %r::DOUBLE, %s)" % x for x in BOOK)}),
h AS (SELECT l_orderkey, l_linenumber, ['claude-sonnet-4-6', 'gpt-5', 'glm-5', 'unknown'][1 + l_suppkey % 4] AS m, CASE WHEN l_linenumber % 2 = 0 THEN floor(l_partkey * 0.7::DOUBLE) ELSE l_suppkey END AS p,
CASE WHEN l_linenumber % 2 = 0 THEN floor(l_partkey * 0.3::DOUBLE) ELSE l_linenumber END AS k, (l_quantity * 3)::BIGINT AS r, l_linenumber AS w FROM lineitem),
b AS (SELECT h.*, coalesce(prompt, 0.002) AS pp, coalesce(completion, 0.002) AS cc, coalesce(ratio, 1.0) AS rr, coalesce(separate, false) AS sep FROM h LEFT JOIN book ON m = model)
SELECT l_orderkey, l_linenumber, round(CASE WHEN sep THEN (p * pp + r * pp * 0.1 + w * pp * 1.25 + k * cc) / 1000 ELSE ((p - least(r, p)) * pp + least(r, p) * pp * rr + k * cc) / 1000 END, 12) AS total_cost,
round(CASE WHEN sep THEN (r * pp * 0.9 - w * pp * 0.25) / 1000 ELSE least(r, p) * pp * (1 - rr) / 1000 END, 12) AS cache_savings FROM b""")
def hop_judge_costs(t: Tables) -> DataFrame:
    """Lines as hops, priced by the model that served them under an alias or with an effort, or else by the asked one."""
    k, odd = c("l_suppkey") % 4, c("l_linenumber") % 2 == 0
    served = F.when(k == 0, "claude-4.6-sonnet").when(k == 1, "gpt-5-latest#high").when(k == 2, "").otherwise("unknown")
    hops = t.lineitem.select("l_orderkey", "l_linenumber", F.when(odd, 0).otherwise(c("l_suppkey")).alias("p"), F.when(odd, 0).otherwise(c("l_linenumber")).alias("k"), c("l_partkey").alias("n"), (c("l_quantity") * 3).cast("long").alias("r"), c("l_linenumber").alias("w"), served.alias("served"), F.lit("glm-5").alias("asked"))
    book = t._spark.createDataFrame(BOOK, "model string, prompt double, completion double, ratio double, separate boolean")
    out = cost.hop_costs(hops, book, "p", "k", "n", "r", "w", "served", "asked", ALIASES)
    return out.select("l_orderkey", "l_linenumber", F.round("total_cost", 12).alias("total_cost"), F.round("cache_savings", 12).alias("cache_savings"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.7 ELSE round(list_avg(list_transform(range(1, (o_orderkey % 4 + 1)::INT), lambda x: [0.9, 0.8, 0.7, 0.5, 0.7][1 + ((o_custkey + x) % 5)::INT])), 9) END::DOUBLE AS confidence FROM orders""")
def safety_confidence(t: Tables) -> DataFrame:
    """Orders as responses with up to three safety ratings."""
    names = F.array(*map(F.lit, ("NEGLIGIBLE", "LOW", "MEDIUM", "HIGH", "UNSPECIFIED")))
    n = (c("o_orderkey") % 4).cast("int")
    ratings = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: F.get(names, ((c("o_custkey") + x) % 5).cast("int"))))
    return t.orders.select("o_orderkey", F.round(evaluation.safety_confidence(ratings), 9).alias("confidence"))


@query(r"""WITH h AS (SELECT l_orderkey, count(*) AS n, sum(l_suppkey)::DOUBLE / 1e6 AS hc, string_agg(printf('    Hop %d: %.2fs (retrieval: %.2fs, evaluation: %.2fs)', i, (l_linenumber + l_quantity) / 100, l_linenumber / 100, l_quantity / 100), chr(10) ORDER BY i) AS hops,
string_agg(printf('      Hop %d LLM (judge-1): $%.6f', i, l_suppkey / 1e6), chr(10) ORDER BY i) AS judged, string_agg(CASE WHEN l_linenumber % 2 = 1 THEN printf('        Hop %d: $%.6f', i, l_suppkey * 50 * 0.02 / 1e6) END, chr(10) ORDER BY i) AS asked
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_suppkey) AS i FROM lineitem) GROUP BY 1),
q AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS rag, o_custkey % 50 + 1 AS e, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 7 END AS he, h.* FROM orders JOIN h ON l_orderkey = o_orderkey),
v AS (SELECT *, e / 1e6 + he / 1e6 + hc AS r, CASE WHEN rag THEN 0 ELSE (k % 1000 + 1) * 4 / 1e6 END AS m FROM q)
SELECT k AS o_orderkey, concat_ws(chr(10), repeat('=', 60), CASE WHEN rag THEN 'SUMMARY (RAG-only mode)' ELSE 'SUMMARY' END, repeat('=', 60), '', printf('Total time: %.2fs', (k % 90 + 500) / 100), printf('  RAG retrieval: %.2fs', (k % 90 + 500 - CASE WHEN rag THEN 0 ELSE 125 END) / 100), '    Initial retrieval: 0.30s', hops,
CASE WHEN NOT rag THEN '  LLM generation: 1.25s' END, '', printf('Total cost: $%.6f', r + m), printf('  RAG costs: $%.6f', r), printf('    Embeddings: $%.6f', (e + he) / 1e6), printf('      Initial query: $%.6f', e / 1e6), CASE WHEN he > 0 THEN '      Hop queries: $0.000007' END, CASE WHEN he > 0 THEN asked END,
CASE WHEN hc > 0 THEN printf('    Hop evaluations: $%.6f', hc) || chr(10) || judged END, CASE WHEN NOT rag THEN printf('  LLM generation: $%.6f', m) || chr(10) || '    Model: gpt-5' || chr(10) || format('    Prompt tokens: {:,}', k) || chr(10) || format('    Completion tokens: {:,}', k + 999) END,
CASE WHEN NOT rag AND k % 2 = 1 THEN printf('    Cache savings:     %s$%.6f (20.0%%)', CASE WHEN k % 4 = 1 THEN '-' ELSE '' END, m / 4) END, repeat('=', 60), '') AS summary FROM v""")
def query_summaries(t: Tables) -> DataFrame:
    """Orders as queries with their lines as hops: what they have taken and cost, in words."""
    k, rag = c("o_orderkey"), c("o_orderkey") % 5 == 0
    hop = F.struct("l_linenumber", (c("l_linenumber") / 100).alias("retrieval_s"), (c("l_quantity") / 100).alias("evaluation_s"), F.when(c("l_linenumber") % 2 == 1, c("l_suppkey") * 50).alias("tokens"), (c("l_suppkey") / 1e6).alias("cost"))
    hops = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(hop)).alias("hops"), (F.sum("l_suppkey") / 1e6).alias("judged"))
    q = t.orders.join(hops, "o_orderkey")
    main = F.when(rag, 0.0).otherwise((k % 1000 + 1) * 4 / 1e6)
    saved = F.when(k % 2 == 0, 0.0).when(k % 4 == 1, -main / 4).otherwise(main / 4)
    asked = (c("o_custkey") % 50 + 1) * 50
    times = summaries.time_lines((k % 90 + 500) / 100, F.lit(0.3), c("hops"), F.when(~rag, 1.25))
    costs = summaries.cost_lines(F.lit(0.0), asked, F.lit("text-embedding-3-small"), F.when(k % 3 == 0, 0.0).otherwise(7e-6), c("judged"), c("hops"), F.lit("judge-1"), main, F.lit("gpt-5"), k, k + 999, saved)
    return q.select("o_orderkey", summaries.summary(times, costs, ~rag).alias("summary"))
