"""Queries that run streams over a table's files to their end, and queries over header trees."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hierarchy
from ..sources.scratch import folder
from ..streaming import ingestion, state, timers
from . import analytics  # noqa: F401  its SQL serves the streams too
from .base import REGISTRY, Tables, query

c = F.col


def _stream(t: Tables, name: str) -> DataFrame:
    return state.read(t._spark, f"{t._folder}/{name}.parquet")


@query(REGISTRY["conversation_sessions"][1])
def stream_session_counts(t: Tables) -> DataFrame:
    return state.run_available(state.session_counts(_stream(t, "events"), "user_id", "ts"), complete=True)


@query(REGISTRY["token_bucket_trace"][1].replace("round(sum(tokens), 3)", "round(sum(tokens), 1)"))
def stream_rate_limit(t: Tables) -> DataFrame:
    base = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    pressed = F.timestamp_micros(F.unix_micros(base) + F.floor((F.unix_micros(c("ts").cast("timestamp")) - F.unix_micros(base)) / 20000).cast("long"))
    trace = state.run_available(state.rate_limited(_stream(t, "events").select("user_id", "event_id", pressed.alias("at")), "user_id", "at", "event_id"))
    return trace.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("allowed"), F.round(F.sum("tokens"), 1).alias("tokens"), F.round(F.max("retry_after"), 3).alias("retry"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS digest, count(*)::BIGINT AS n FROM l WHERE n <= 10 GROUP BY conv_id""")
def stream_conversation_memory(t: Tables) -> DataFrame:
    held = state.run_available(state.conversation_memory(_stream(t, "conversations"), "conv_id", "turn", "role", "text"))
    last = held.groupBy("conv_id").agg(F.max_by("messages", F.array_max("orders")).alias("m"))
    return last.select("conv_id", F.md5(F.array_join("m", "\n")).alias("digest"), F.size("m").cast("long").alias("n"))


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 30 MINUTE AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, count_if(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, max(s) OVER (PARTITION BY user_id) AS last FROM s)
SELECT user_id, count(*)::BIGINT AS n, string_agg(event_type || ': ' || event_id, ',' ORDER BY ts, event_id) AS messages, max(ts) + INTERVAL 90 MINUTE < (SELECT max(ts) FROM events) AS expired FROM l WHERE s = last AND n <= 10 GROUP BY user_id""")
def stream_memory_timers(t: Tables) -> DataFrame:
    """What is remembered of each user's events, and whether it is forgotten by the end: half an hour's pause, an hour late."""
    out = timers.run_available(timers.memory(_stream(t, "events"), "user_id", "ts", "event_id", "event_type", "event_id"))
    last = out.groupBy("user_id").agg(F.max_by("messages", F.struct("at", ~c("expired"))).alias("m"), F.max("expired").alias("expired"))
    return last.select("user_id", F.size("m").cast("long").alias("n"), F.array_join("m", ",").alias("messages"), "expired")


@query("""WITH v AS (SELECT user_id, event_id, event_id % 40 AS target, event_type AS vote FROM events WHERE event_type IN ('click', 'purchase')), l AS (SELECT target, user_id, arg_max(vote, event_id) AS vote FROM v GROUP BY ALL)
SELECT target, count_if(vote = 'click')::BIGINT AS ups, count_if(vote = 'purchase')::BIGINT AS downs FROM l GROUP BY target""")
def stream_vote_counts(t: Tables) -> DataFrame:
    v = _stream(t, "events").where("event_type in ('click', 'purchase')").select("user_id", "event_id", (c("event_id") % 40).alias("target"), c("event_type").alias("vote"))
    held = state.run_available(state.latest_votes(v, "target", "user_id", "vote", "event_id"), complete=True)
    return held.groupBy("target").agg(F.count_if(c("vote") == "click").alias("ups"), F.count_if(c("vote") == "purchase").alias("downs"))


KIND = "CASE WHEN doc_id % 11 = 3 AND {k} = 1 THEN 'x' ELSE 'faq' END"
BODY = "replace(text, '. ', '.' || chr(10) || '## ')"


def _run_sql(k: int) -> str:
    """Files of listing k, and the record that follows from the one before."""
    listed = f"""l{k} AS (SELECT doc_id, 'a/' || doc_id || '.md' AS path, {BODY} || CASE WHEN doc_id % 5 = {k} THEN '!' ELSE '' END AS body, {KIND.format(k=k)} AS kind FROM documents WHERE (doc_id + {k}) % 7 <> 0),
c{k} AS (SELECT path, kind = 'faq' AS fine, sha256('---' || chr(10) || 'source: s' || chr(10) || 'last_update_date: 2024-01-01' || chr(10) || 'document_type: ' || kind || chr(10) || '---' || chr(10) || body) AS hash, 1 + len(regexp_extract_all(body, '(?m)^## ')) AS chunks FROM l{k})"""
    before = f"(SELECT * FROM s{k - 1} WHERE hash IS NOT NULL)" if k else "(SELECT NULL::VARCHAR AS path, NULL::VARCHAR AS hash, NULL::BIGINT AS chunks WHERE false)"
    fresh = "c.hash IS NOT NULL AND fine AND (b.hash IS NULL OR b.hash <> c.hash)"
    return f"""{listed}, s{k} AS (SELECT {k}::BIGINT AS run, coalesce(c.path, b.path) AS path, CASE WHEN c.hash IS NULL THEN 'removed' WHEN b.hash = c.hash THEN 'unchanged' WHEN NOT fine THEN 'invalid' WHEN b.hash IS NULL THEN 'new' ELSE 'changed' END AS state,
CASE WHEN c.hash IS NULL THEN NULL WHEN {fresh} THEN c.hash ELSE b.hash END AS hash, CASE WHEN c.hash IS NULL THEN NULL WHEN {fresh} THEN c.chunks ELSE b.chunks END::BIGINT AS chunks FROM c{k} c FULL JOIN {before} b ON b.path = c.path)"""


@query(f"WITH {', '.join(map(_run_sql, range(3)))} SELECT run, path, state, hash, chunks FROM s0 UNION ALL SELECT run, path, state, hash, chunks FROM s1 UNION ALL SELECT run, path, state, hash, chunks FROM s2")
def stream_ingestion(t: Tables) -> DataFrame:
    """Three listings of all documents as files, between which files come, change, go and become invalid."""
    spark, place = t._spark, folder(t._spark, "listings")
    d = t.documents.withColumn("body", F.replace("text", F.lit(". "), F.lit(".\n## ")))
    for k in range(3):
        kind = F.when((c("doc_id") % 11 == 3) & F.lit(k == 1), "x").otherwise("faq")
        text = F.concat(F.lit("---\nsource: s\nlast_update_date: 2024-01-01\ndocument_type: "), kind, F.lit("\n---\n"), "body", F.when(c("doc_id") % 5 == k, "!").otherwise(""))
        d.where((c("doc_id") + k) % 7 != 0).select(F.concat(F.lit("a/"), "doc_id", F.lit(".md")).alias("path"), text.alias("text")).write.parquet(f"{place}/run-{k}")
        spark.createDataFrame([(k, f"{place}/run-{k}")], "run long, listing string").coalesce(1).write.mode("append").json(f"{place}/notices")
    own = ingestion.Ingestion(spark, f"{place}/records", "tree")
    own.ingest(ingestion.notices(spark, f"{place}/notices"))
    return own.states().select("run", "path", "state", "hash", "chunks")


MD = "list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 2 = 1 THEN repeat('#', 2 + ((i * 7 + doc_id) % 3)::INT) || ' **' || x || '**' ELSE x END)"
TREE = f"""ln AS (SELECT doc_id, unnest({MD}) AS line, generate_subscripts({MD}, 1) - 1 AS node FROM documents),
hd AS (SELECT doc_id, node, length(regexp_extract(line, '^(#{{2,6}}) ', 1)) AS level, trim(replace(regexp_replace(line, '^#+\\s*', ''), '*', ''), ' ' || chr(9) || chr(10) || chr(13)) AS title FROM ln WHERE regexp_matches(line, '^#{{2,6}} ')),
tr AS (SELECT h.*, (SELECT max(p.node) FROM hd p WHERE p.doc_id = h.doc_id AND p.node < h.node AND p.level = h.level - 1 AND NOT EXISTS (SELECT 1 FROM hd q WHERE q.doc_id = h.doc_id AND q.node > p.node AND q.node < h.node AND q.level < h.level - 1)) AS parent FROM hd h)"""


@query(f"WITH {TREE} SELECT doc_id, node::INT AS node, level::INT AS level, md5(title) AS title, parent::INT AS parent FROM tr")
def header_tree(t: Tables) -> DataFrame:
    """Every second line of a document made a header of level 2 to 4."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.repeat(F.lit("#"), (F.lit(2) + ((i + 1) * 7 + c("doc_id")) % 3).cast("int")), F.lit(" **"), x, F.lit("**"))).otherwise(x))
    md = t.documents.select("doc_id", F.array_join(lines, "\n").alias("md"))
    nodes = hierarchy.tree(hierarchy.headers(md, "doc_id", "md"), "doc_id")
    return nodes.select("doc_id", "node", "level", F.md5("title").alias("title"), "parent")


@query("""WITH x AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' - Tac Op - Security' WHEN 1 THEN ' - STRATEGY PLOY' WHEN 2 THEN ' - Equipment' ELSE '' END AS title FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(upper(title), '^(FAQ|\\[FAQ\\])') THEN NULL WHEN contains(upper(title), 'OPERATIVE SELECTION') THEN 'Operative Selection' WHEN contains(upper(title), 'FACTION RULE') OR ends_with(upper(title), '- ARCHETYPES') THEN 'Faction Rules' WHEN contains(upper(title), 'STRATEGY PLOY') THEN 'Strategy Ploys'
WHEN contains(upper(title), 'FIREFIGHT PLOY') THEN 'Firefight Ploys' WHEN contains(upper(title), 'FACTION EQUIPMENT') THEN 'Faction Equipment' WHEN contains(title, ' - ') AND NOT regexp_matches(upper(title), 'FACTION RULE|PLOY|EQUIPMENT|SELECTION|ARCHETYPE') THEN 'Operatives' END AS category,
CASE WHEN p_partkey % 4 = 0 THEN 'SECURITY' END AS archetype FROM x""")
def title_categories(t: Tables) -> DataFrame:
    k = c("p_partkey") % 4
    title = F.concat("p_name", F.when(k == 0, " - Tac Op - Security").when(k == 1, " - STRATEGY PLOY").when(k == 2, " - Equipment").otherwise(""))
    return t.part.select("p_partkey", F.nullif(hierarchy.category(title), F.lit("")).alias("category"), hierarchy.archetype(title).alias("archetype"))


@query(f"WITH {TREE} SELECT doc_id, md5(string_agg(title, '|' ORDER BY node)) AS digest FROM hd GROUP BY doc_id")
def flattened_titles(t: Tables) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.repeat(F.lit("#"), (F.lit(2) + ((i + 1) * 7 + c("doc_id")) % 3).cast("int")), F.lit(" **"), x, F.lit("**"))).otherwise(x))
    md = t.documents.select("doc_id", F.array_join(lines, "\n").alias("md"))
    return hierarchy.flattened(hierarchy.headers(md, "doc_id", "md"), "doc_id").select("doc_id", F.md5(F.array_join("titles", "|")).alias("digest"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\w\s-]', '', 'g'), '[\s-]+', '_', 'g'), '_') AS file FROM part""")
def team_file_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.btrim(F.regexp_replace(F.regexp_replace(F.lower("p_name"), r"[^\w\s-]", ""), r"[\s-]+", "_"), F.lit("_")).alias("file"))


@query("""SELECT event_id, (json_extract(props, '$.k'))::INT AS k, '{"a":' || event_id || ',"q":[' || (event_id % 3) || ']}' AS packed FROM events""")
def json_fields(t: Tables) -> DataFrame:
    props = F.from_json("props", "k int")
    packed = F.to_json(F.struct(c("event_id").alias("a"), F.array(c("event_id") % 3).alias("q")))
    return t.events.select("event_id", props["k"].alias("k"), packed.alias("packed"))


@query("""SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AND length(c_name) <= 20 AS valid, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'score' END, CASE WHEN length(c_name) > 20 THEN 'length' END, CASE WHEN c_acctbal > 5000 THEN 'range' END], lambda x: x IS NOT NULL), ',') AS faults FROM customer""")
def invariant_checks(t: Tables) -> DataFrame:
    """Rows against a list of rules, with the names of those that they break."""
    from ..operators.invariants import broken

    rules = {"score": c("c_acctbal") >= 0, "length": F.length("c_name") <= 20, "range": c("c_acctbal") <= 5000}
    faults = broken(rules)
    return t.customer.select("c_custkey", (F.size(faults) == 0).alias("valid"), F.array_join(faults, ",").alias("faults"))


