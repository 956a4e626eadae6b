"""Queries over single records: frontmatter, downloads, citations, parts of cost, invariants, and files that are read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frontmatter, invariants, records
from ..sources import files
from ..sources.scratch import folder
from .base import Tables, query

c = F.col
md5 = F.md5

#: Blocks of frontmatter, by doc_id modulo their number, and (version, updated, kind, refused) of each.
BLOCKS = [
    ('source: "a: b"\nlast_update_date: 2024-02-03\ndocument_type: faq', ("a: b", "2024-02-03", "faq", None)),
    ("source: 'it''s'\nlast_update_date: '2024-02-03'\ndocument_type: \"team-rules\"", ("it's", "2024-02-03", "team-rules", None)),
    ("source: >\n  one\n  two\nlast_update_date: 2024-02-03\ndocument_type: ops # kind", ("one two\n", "2024-02-03", "ops", None)),
    ("last_update_date: 2024-02-03\ndocument_type: faq\nmore:\n  - 1\n  - x: y", ("Unknown", "2024-02-03", "faq", None)),
    ("source: [1, 2\nlast_update_date: 2024-02-03", ("Unknown", None, None, "yaml")),
    ("- source", ("Unknown", None, None, "mapping")),
    ("source: 3.1\nlast_update_date: 2024-02-31\ndocument_type: faq", ("Unknown", None, None, "yaml")),
    ("source: null\nlast_update_date: soon\ndocument_type: faq", (None, None, "faq", "last_update_date")),
    ("source: s\nlast_update_date: 2024-02-03\ndocument_type: [faq]", ("s", "2024-02-03", '["faq"]', "document_type")),
    ("source: s\nlast_update_date: 2024-02-03\ndocument_type: other", ("s", "2024-02-03", "other", "document_type")),
    ("", (None, None, None, "missing")),
]


def _literal(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"""WITH b(i, version, updated, kind, refused) AS (VALUES {", ".join(f"({k}, {', '.join(map(_literal, x))})" for k, (_, x) in enumerate(BLOCKS))})
SELECT doc_id, CASE WHEN refused = 'missing' THEN 'Unknown' ELSE version END AS version, updated::DATE AS updated, kind, refused FROM documents JOIN b ON i = doc_id % {len(BLOCKS)}""")
def frontmatter_documents(t: Tables) -> DataFrame:
    """Documents behind frontmatter with quoted, folded, nested and faulty values."""
    block = F.get(F.array(*(F.lit(x) for x, _ in BLOCKS)), (c("doc_id") % len(BLOCKS)).cast("int"))
    md = t.documents.select("doc_id", F.when(block == "", c("text")).otherwise(F.concat(F.lit("---\n"), block, F.lit("\n---\n"), "text")).alias("md"))
    out = frontmatter.documents(md, "md")
    return out.select("doc_id", F.when(c("refused") == "missing", "Unknown").otherwise(c("version")).alias("version"), "updated", "kind", "refused")


@query(r"""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS team, '# x' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '## ' || upper(CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE p_type END) END AS body FROM part),
m AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN '---' || chr(10) || 'source: "WC downloads"' || chr(10) || 'last_update_date: 2024-05-06' || chr(10) || 'document_type: team-rules' || chr(10) || 'section: ' || team || chr(10) || '---' || chr(10) || chr(10) || body ELSE body END AS md FROM p)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT starts_with(md, '---') THEN 'frontmatter' END, CASE WHEN NOT contains(md, 'source:') THEN 'source' END, CASE WHEN NOT contains(md, 'last_update_date:') THEN 'last_update_date' END, CASE WHEN NOT contains(md, 'document_type:') THEN 'document_type' END,
CASE WHEN NOT contains(md, 'section:') THEN 'section' END, CASE WHEN NOT contains(upper(md), '## ' || upper(replace(team, '_', ' '))) THEN 'team' END, CASE WHEN NOT contains(md, '## ') THEN 'headers' END], lambda x: x IS NOT NULL), ',') AS warnings FROM m""")
def download_warnings(t: Tables) -> DataFrame:
    """Parts as downloads of teams; every second has frontmatter, and two of three have headers."""
    k = c("p_partkey")
    body = F.concat(F.lit("# x\n"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("## "), F.upper(F.when(k % 3 == 1, c("p_name")).otherwise(c("p_type"))))))
    rows = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("team"), body.alias("body"))
    md = F.when(k % 2 == 0, records.with_front(c("body"), c("team"), F.lit("2024-05-06").cast("date"))).otherwise(c("body"))
    return rows.select("p_partkey", F.array_join(records.download_warnings(md, c("team")), ",").alias("warnings"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN DATE '1970-01-01' + (o_orderkey % 20000)::INT WHEN 2 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def listing_days(t: Tables) -> DataFrame:
    """Order days as a listing tells them: as text, as a time stamp where the text is none, or not at all."""
    k, day = c("o_orderkey"), c("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(day, "dd/MM/yyyy")).when(k % 4 == 1, "31/02/2024").when(k % 4 == 3, F.date_format(day, "d/M/yyyy"))
    seconds = F.when(k % 4 == 1, (k % 20000) * 86400 + 5).otherwise(0)
    return t.orders.select("o_orderkey", records.listing_day(text, seconds).alias("day"))


@query(r"""WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '.' || p_partkey WHEN 1 THEN 'FAQ-2024-' || lpad((p_size % 100)::VARCHAR, 2, '0') WHEN 2 THEN 'v2024-1' WHEN 3 THEN '1.2.3' WHEN 4 THEN p_name ELSE 'Abc2024-09' END AS version, CASE WHEN p_size % 3 = 0 THEN 'http://x/' ELSE 'https://x/' END || p_partkey AS url FROM part)
SELECT p_partkey, starts_with(url, 'https://') AS url_ok, regexp_full_match(version, '\d+\.\d+') OR regexp_full_match(version, '[A-Za-z]+-?\d{4}-\d{2}') AS version_ok FROM v""")
def update_checks(t: Tables) -> DataFrame:
    """Parts as updates with an address and a version."""
    k, size = c("p_partkey"), c("p_size")
    version = F.when(k % 6 == 0, F.concat_ws(".", size.cast("string"), k.cast("string"))).when(k % 6 == 1, F.concat(F.lit("FAQ-2024-"), F.lpad((size % 100).cast("string"), 2, "0"))).when(k % 6 == 2, "v2024-1").when(k % 6 == 3, "1.2.3").when(k % 6 == 4, c("p_name")).otherwise("Abc2024-09")
    url = F.concat(F.when(size % 3 == 0, "http://x/").otherwise("https://x/"), k.cast("string"))
    return t.part.select("p_partkey", records.valid_url(url).alias("url_ok"), records.valid_version(version).alias("version_ok"))


@query("""SELECT doc_id, coalesce(nullif(source, 'none'), 'Unknown') AS document, CASE WHEN doc_id % 3 = 0 THEN 'General' ELSE lang END AS section, md5(CASE WHEN doc_id % 5 = 1 THEN '[SMALLTALK] ' || text ELSE text END) AS quote, CASE WHEN doc_id % 2 = 0 THEN 'core-rules' ELSE 'faq' END AS kind,
CASE WHEN doc_id % 4 = 0 THEN DATE '2024-01-15' ELSE DATE '2024-03-04' END AS updated FROM documents WHERE doc_id % 5 <> 1 AND doc_id % 7 <> 0""")
def answer_citations(t: Tables) -> DataFrame:
    """Documents as the chunks of answers; smalltalk, told by a flag or by its tag, has no citations."""
    k = c("doc_id")
    rows = t.documents.withColumns({"header": F.when(k % 3 == 0, "").otherwise(c("lang")), "kind": F.when(k % 2 == 1, "faq"), "day": F.when(k % 4 != 0, "2024-03-04"), "flag": F.when(k % 2 == 0, k % 7 == 0).otherwise(k % 7 == 0)})
    rows = rows.withColumn("answer", F.when(k % 5 == 1, F.concat(F.lit("[SMALLTALK] "), "text")).otherwise(c("text")))
    talk, shown = records.smalltalk(c("flag"), c("answer"))
    told = records.citations(rows.where(~talk).withColumn("shown", shown), "source", "header", "shown", "kind", "day")
    return told.select("doc_id", "citation.document", "citation.section", md5("citation.quote").alias("quote"), "citation.kind", "citation.updated")


@query("""WITH h AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_suppkey END) AS tokens, sum(l_tax / 100) AS hop FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
q AS (SELECT o_orderkey, o_custkey * 0.02::DOUBLE / 1000000 AS a, coalesce(tokens, 0) * 0.02::DOUBLE / 1000000 AS b, coalesce(hop, 0) AS h, o_totalprice / 1e6 AS m FROM orders LEFT JOIN h ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(a, 12) AS initial_embedding, round(b, 12) AS hop_embedding, round(h, 10) AS hop_evaluation, round(m, 12) AS main_llm, round(a + b + h + m, 10) AS total FROM q""")
def query_cost_parts(t: Tables) -> DataFrame:
    """Orders as queries, their lines but the first as hops."""
    hops = t.lineitem.where("l_linenumber > 1").select(c("l_orderkey").alias("o_orderkey"), F.when(c("l_linenumber") % 2 == 1, c("l_suppkey")).alias("tokens"), (c("l_tax") / 100).alias("cost"))
    q = t.orders.select("o_orderkey", c("o_custkey").alias("asked"), F.lit("text-embedding-3-small").alias("model"), (c("o_totalprice") / 1e6).alias("main"))
    out = records.query_costs(q, hops, "o_orderkey", "asked", "model", "main", "tokens", "cost")
    digits = {"initial_embedding": 12, "hop_embedding": 12, "hop_evaluation": 10, "main_llm": 12, "total": 10}
    return out.select("o_orderkey", *(F.round(k, n).alias(k) for k, n in digits.items()))


@query("""SELECT event_id, event_id % 900 + 100 - floor(value / 100 * 1000)::BIGINT AS retrieval, floor(value / 100 * 1000)::BIGINT AS hops, event_id % 50 AS main, CASE WHEN event_id % 2 = 0 THEN 5000 ELSE event_id % 900 + 100 + event_id % 50 END::BIGINT AS total FROM events WHERE value IS NOT NULL""")
def query_latency_parts(t: Tables) -> DataFrame:
    """Events as queries, their value as the seconds that hops have taken."""
    k = c("event_id")
    parts = records.latency_parts(k % 900 + 100, c("value") / 100, k % 50, F.when(k % 2 == 0, 5000))
    return t.events.where("value is not null").select("event_id", parts.alias("p")).select("event_id", "p.retrieval", "p.hops", "p.main", c("p.total").cast("long").alias("total"))


# -- invariants ------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_orderkey, list(l_discount * CASE WHEN l_orderkey % 9 = 0 THEN 20 ELSE 10 END ORDER BY CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE -l_discount END, l_discount) AS s FROM lineitem GROUP BY 1),
m AS (SELECT *, round(list_avg(s), 9) AS mean, CASE WHEN l_orderkey % 5 = 0 THEN true ELSE round(list_avg(s), 9) >= 0.45 END AS meets FROM g)
SELECT l_orderkey, array_to_string(list_filter([CASE WHEN list_min(s) < 0 OR list_max(s) > 1 THEN 'range' END, CASE WHEN len(list_filter(s, lambda x, i: i > 1 AND s[i - 1] < x)) > 0 THEN 'order' END, CASE WHEN meets <> (mean >= 0.45) THEN 'flag' END], lambda x: x IS NOT NULL), ',') AS broken FROM m""")
def context_invariants(t: Tables) -> DataFrame:
    """Orders as contexts with their lines' discounts as scores, some in the wrong order, out of range or with a wrong flag."""
    k = c("l_orderkey")
    item = F.struct(F.when(k % 3 == 0, c("l_linenumber").cast("double")).otherwise(-c("l_discount")).alias("o"), (c("l_discount") * F.when(k % 9 == 0, 20).otherwise(10)).alias("s"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]).alias("scores"), F.round(F.avg(c("l_discount") * F.when(k % 9 == 0, 20).otherwise(10)), 9).alias("mean_score"))
    g = g.withColumn("meets", F.when(k % 5 == 0, True).otherwise(c("mean_score") >= 0.45))
    return g.select("l_orderkey", F.array_join(invariants.broken(invariants.context_rules("scores")), ",").alias("broken"))


@query("""WITH d AS (SELECT doc_id, repeat(text, 1 + (doc_id % 4)::INT) AS x, (doc_id % 13) / 10 AS conf, (doc_id % 11) / 10 AS rel, CASE WHEN doc_id % 6 = 0 THEN []::VARCHAR[] ELSE [source, substr(text, 1, 150 + (doc_id % 100)::INT)] END AS q FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN length(x) > 4000 THEN 'length' END, CASE WHEN conf > 1 OR rel > 1 THEN 'scores' END, CASE WHEN len(q) = 0 THEN 'citations' END, CASE WHEN len(list_filter(q, lambda y: length(y) NOT BETWEEN 1 AND 200)) > 0 THEN 'quotes' END], lambda x: x IS NOT NULL), ',') AS broken FROM d""")
def response_invariants(t: Tables) -> DataFrame:
    """Documents as responses."""
    k = c("doc_id")
    quote = F.substring("text", F.lit(1), (150 + k % 100).cast("int"))
    rows = t.documents.select("doc_id", F.expr("repeat(text, int(1 + doc_id % 4))").alias("x"), (k % 13 / 10).alias("conf"), (k % 11 / 10).alias("rel"), F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("source", quote)).alias("q"))
    return rows.select("doc_id", F.array_join(invariants.broken(invariants.response_rules("x", "conf", "rel", "q")), ",").alias("broken"))


@query("""WITH e AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN repeat('x', 2001) ELSE event_type END AS x, CASE WHEN event_id % 7 = 0 THEN 'key' ELSE 'c:' || user_id END AS k FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN length(trim(x)) NOT BETWEEN 1 AND 2000 THEN 'text' END, CASE WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY THEN 'age' END, CASE WHEN NOT contains(k, ':') THEN 'key' END], lambda x: x IS NOT NULL), ',') AS broken FROM e""")
def query_invariants(t: Tables) -> DataFrame:
    """Events as queries, looked at on the twentieth of January."""
    k = c("event_id")
    rows = t.events.select("event_id", c("ts").cast("timestamp").alias("ts"), F.when(k % 5 == 0, "  ").when(k % 5 == 1, F.repeat(F.lit("x"), 2001)).otherwise(c("event_type")).alias("x"), F.when(k % 7 == 0, "key").otherwise(F.concat(F.lit("c:"), "user_id")).alias("k"))
    return rows.select("event_id", F.array_join(invariants.broken(invariants.query_rules("x", "ts", "k", datetime(2024, 1, 20))), ",").alias("broken"))


# -- files that are read back ----------------------------------------------------------------


@query("""SELECT conv_id::VARCHAR AS context_id, count(*)::INT AS chunks, round(avg(turn / 10), 6) AS mean, md5(string_agg(text, '|' ORDER BY turn)) AS digest, max(turn)::INT AS last_hop FROM conversations GROUP BY conv_id""")
def context_files(t: Tables) -> DataFrame:
    """Conversations written as stored contexts and read back."""
    s = lambda x: c(x).cast("string")
    of = {"chunk_id": lambda x: F.concat_ws(":", s("conv_id"), x["turn"].cast("string")), "document_id": lambda x: s("conv_id"), "text": lambda x: x["text"], "header": lambda x: x["role"], "header_level": lambda x: F.lit(2)}
    of |= {"relevance_score": lambda x: x["turn"] / 10, "position_in_doc": lambda x: x["turn"].cast("int"), "metadata": lambda x: F.create_map(F.lit("role"), x["role"])}
    g = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("turns"), F.avg(c("turn") / 10).alias("avg_relevance"), F.count("*").cast("int").alias("total_chunks"))
    g = g.withColumn("document_chunks", F.transform("turns", lambda x: F.struct(*(f(x).alias(k) for k, f in of.items()))))
    context = F.struct(s("conv_id").alias("context_id"), F.lit("q").alias("query_id"), "total_chunks", "avg_relevance", F.lit(True).alias("meets_threshold"), "document_chunks")
    hops = F.map_from_entries(F.transform("document_chunks", lambda x: F.struct(x["chunk_id"], x["position_in_doc"])))
    place = folder(t._spark, "contexts")
    files.write_contexts(g.select(context.alias("rag_context"), hops.alias("chunk_hop_map"), F.lit(0.5).alias("embedding_cost")), place)
    back = files.contexts(t._spark, place, lines=True)
    texts = F.array_join(F.transform("rag_context.document_chunks", lambda x: x["text"]), "|")
    return back.select("rag_context.context_id", c("rag_context.total_chunks").alias("chunks"), F.round("rag_context.avg_relevance", 6).alias("mean"), md5(texts).alias("digest"), F.array_max(F.map_values("chunk_hop_map")).alias("last_hop"))


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10000""")
def exported_rows(t: Tables) -> DataFrame:
    """The newest ten thousand orders as CSV, read back; the number is the feature."""
    place = folder(t._spark, "export")
    rows = t.orders.withColumn("newest", F.struct("o_orderdate", "o_orderkey")).select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"), "newest")
    files.export(rows, place, "csv", "newest", drop=True)
    return t._spark.read.option("header", "true").schema("o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").csv(place)


@query("""SELECT conv_id, 'Turn ' || turn AS section, turn % 2 = 0 AS missing FROM conversations""")
def report_sections(t: Tables) -> DataFrame:
    """A report of each conversation with a section for each turn, taken apart again."""
    part = F.concat(F.lit("## Turn "), c("turn").cast("string"), F.lit("\n\n"), F.when(c("turn") % 2 == 0, "**Missing** ❌").otherwise("**Found**"), F.lit("\n"))
    g = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("# Report\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "")).alias("report"))
    return files.report_sections(g, "report", "conv_id")


@query("""SELECT 'case-' || item_id AS test_id, md5(text) AS query, 'k' || n AS key, md5(substr(text, n::INT + 1, 20)) AS text, ['critical', 'important', 'supporting'][1 + n] AS priority, 'set ' || item_id AS codename FROM benchmark, range(3) r(n)""")
def test_case_files(t: Tables) -> DataFrame:
    """Benchmark texts written as test cases, a file each, and read back."""
    truths = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.struct(F.concat(F.lit("k"), n.cast("string")).alias("key"), F.substring("text", n + 1, F.lit(20)).alias("text"), F.get(F.array(*map(F.lit, ("critical", "important", "supporting"))), n).alias("priority")))
    cases = t.benchmark.select(F.concat(F.lit("case-"), "item_id").alias("test_id"), c("text").alias("query"), truths.alias("truths"), F.concat(F.lit("set "), "item_id").alias("codename"))
    place = folder(t._spark, "cases")
    files.write_test_cases(cases, place)
    back = files.test_cases(t._spark, place, "part-*")
    return back.select("test_id", md5("query").alias("query"), "key", md5("text").alias("text"), "priority", "codename")
