"""Queries over messages, prompt blocks, the result cache and reactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import messages as M
from ..streaming import state
from .base import Tables, query

c = F.col
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH s AS (SELECT doc_id, text, list_reduce(list_transform(string_split(text, '. '), lambda s: {{'done': []::VARCHAR[], 'now': CASE WHEN ends_with(s, '.') THEN s ELSE s || '.' END || ' '}}),
lambda a, b: CASE WHEN length(a.now) + length(b.now) - 1 <= 1900 THEN {{'done': a.done, 'now': a.now || b.now}} ELSE {{'done': list_append(a.done, trim(a.now, {TRIM})), 'now': b.now}} END) AS r FROM documents),
m AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN [text] ELSE list_append(r.done, trim(r.now, {TRIM})) END AS m FROM s)
SELECT doc_id, len(m)::INT AS n, md5(array_to_string(m, '|')) AS digest FROM m""")
def message_chunks(t: Tables) -> DataFrame:
    """Each document as an answer that is sent in messages."""
    m = t.documents.select("doc_id", M.packed(c("text")).alias("m"))
    return m.select("doc_id", F.size("m").alias("n"), F.md5(F.array_join("m", "|")).alias("digest"))


def _folded_sql(parts: str, joint: str, tidy: str) -> str:
    """Pieces of up to 1024 characters of a list of parts."""
    last = tidy.format("a.now")
    hard = tidy.format("substr(b.now, k, 1024)")
    return f"""list_reduce({parts}, lambda a, b: CASE WHEN length(b.now) > 1024 THEN {{'done': list_concat(CASE WHEN a.now = '' THEN a.done ELSE list_append(a.done, {last}) END, list_transform(range(1, length(b.now)::BIGINT + 1, 1024), lambda k: {hard})), 'now': ''}}
WHEN length(CASE WHEN a.now = '' THEN b.now ELSE a.now || {joint} || b.now END) <= 1024 THEN {{'done': a.done, 'now': CASE WHEN a.now = '' THEN b.now ELSE a.now || {joint} || b.now END}}
ELSE {{'done': CASE WHEN a.now = '' THEN a.done ELSE list_append(a.done, {last}) END, 'now': b.now}} END, {{'done': []::VARCHAR[], 'now': ''}})"""


def _pieces_sql(source: str, parts: str, joint: str, tidy: str) -> str:
    return f"""WITH x AS ({source}), r AS (SELECT doc_id, text, {_folded_sql(f"list_transform({parts}, lambda s: {{'done': []::VARCHAR[], 'now': s}})", joint, tidy)} AS r FROM x),
m AS (SELECT doc_id, CASE WHEN length(text) <= 1024 THEN [text] WHEN r.now = '' THEN r.done ELSE list_append(r.done, {tidy.format("r.now")}) END AS m FROM r)
SELECT doc_id, len(m)::INT AS n, coalesce(list_max(list_transform(m, lambda p: length(p))), 0)::INT AS longest, md5(array_to_string(m, '|')) AS digest FROM m"""


def _pieces(df: DataFrame, pieces) -> DataFrame:
    m = df.select("doc_id", pieces(c("text")).alias("m"))
    return m.select("doc_id", F.size("m").alias("n"), F.coalesce(F.array_max(F.transform("m", F.length)), F.lit(0)).alias("longest"), F.md5(F.array_join("m", "|")).alias("digest"))


@query(_pieces_sql("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '.', '') ELSE text END AS text FROM documents", r"regexp_extract_all(text, '(?s).*?[.!?]+\s+|(?s).+')", "''", f"trim({{}}, {TRIM})"))
def field_pieces(t: Tables) -> DataFrame:
    """Documents as fields of messages; every third has no full stops and is cut hard."""
    return _pieces(t.documents.select("doc_id", F.when(c("doc_id") % 3 == 0, F.replace("text", F.lit("."), F.lit(""))).otherwise(c("text")).alias("text")), M.field_pieces)


@query(_pieces_sql("SELECT doc_id, '> ' || CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, '. ', '.' || chr(10) || '> ') END AS text FROM documents", "string_split(text, chr(10))", "chr(10)", "{}"))
def quote_pieces(t: Tables) -> DataFrame:
    """Documents as quotes, a mark before each line."""
    lines = F.when(c("doc_id") % 3 == 0, c("text")).otherwise(F.replace("text", F.lit(". "), F.lit(".\n> ")))
    return _pieces(t.documents.select("doc_id", F.concat(F.lit("> "), lines).alias("text")), M.quote_pieces)


@query(f"""WITH p AS (SELECT doc_id, replace(text, chr(10), '<!--CACHE_BREAK-->') AS x FROM documents), s AS (SELECT doc_id, x, string_split(x, '<!--CACHE_BREAK-->') AS p FROM p),
b AS (SELECT doc_id, x, len(p) AS n, list_filter(list_transform(p, lambda v, i: {{'text': trim(v, {TRIM}), 'cached': i < len(p)}}), lambda v: v.text <> '') AS b FROM s),
r AS (SELECT doc_id, x, CASE WHEN n = 1 OR len(b) = 0 THEN [{{'text': x, 'cached': false}}] ELSE b END AS b FROM b)
SELECT doc_id, len(b)::INT AS n, len(list_filter(b, lambda v: v.cached))::INT AS cached, md5(array_to_string(list_transform(b, lambda v: v.text), '|')) AS digest, md5(trim(replace(x, '<!--CACHE_BREAK-->', ''), {TRIM})) AS plain FROM r""")
def prompt_cache_blocks(t: Tables) -> DataFrame:
    """Each document as a prompt with a mark in place of each line's end."""
    x = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit(M.CACHE_MARK)).alias("x"))
    b = x.select("doc_id", M.cache_blocks(c("x")).alias("b"), M.without_marks(c("x")).alias("p"))
    cached = F.size(F.filter("b", lambda v: v["cached"]))
    return b.select("doc_id", F.size("b").alias("n"), cached.alias("cached"), F.md5(F.array_join(F.transform("b", lambda v: v["text"]), "|")).alias("digest"), F.md5("p").alias("plain"))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) AS t FROM events), nx AS (SELECT user_id, event_type, t, min(t) OVER (PARTITION BY user_id, event_type ORDER BY t RANGE BETWEEN 86400000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM d),
s AS (SELECT user_id, event_type, min(t) AS t FROM d GROUP BY ALL UNION ALL SELECT s.user_id, s.event_type, nx.n FROM s JOIN nx ON s.user_id = nx.user_id AND s.event_type = nx.event_type AND s.t = nx.t AND nx.n IS NOT NULL),
m AS (SELECT user_id, count(*) AS misses FROM s GROUP BY user_id) SELECT user_id, n, n - misses AS hits FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) JOIN m USING (user_id)""")
def result_cache_hits(t: Tables) -> DataFrame:
    """Each event as a request for its type by its user, with results kept for a day."""
    trace = M.cache_trace(t.events, "event_type", "user_id", "ts", "event_id", ttl=86_400)
    return trace.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("""SELECT event_id % 40 AS target, count_if(event_type = 'click')::BIGINT AS ups, count_if(event_type = 'purchase')::BIGINT AS downs FROM events WHERE event_type IN ('click', 'purchase') AND user_id <> 1 GROUP BY ALL""")
def stream_reaction_counts(t: Tables) -> DataFrame:
    """Clicks and purchases as reactions; those of user 1 are our own and do not count."""
    emoji = F.when(c("event_type") == "click", "👍").when(c("event_type") == "purchase", "👎").otherwise(c("event_type"))
    rows = state.read(t._spark, f"{t._folder}/events.parquet").select((c("event_id") % 40).alias("target"), "user_id", emoji.alias("emoji"))
    return state.run_available(state.reaction_counts(rows, "target", "user_id", "emoji", 1), complete=True)
