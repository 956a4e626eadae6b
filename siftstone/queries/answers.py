"""Queries over structured answers, their prompts, measures and messages, and over titles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import chunking, evaluation, hierarchy, shapes, terms
from ..operators import invariants as I
from .base import Tables, query
from .texts import NORMAL

c = F.col


def _normal(column: str) -> str:
    return NORMAL.replace("text", column, 1)


def _turns(t: Tables) -> DataFrame:
    return t.conversations.withColumn("chunk_id", F.md5(F.concat(c("conv_id").cast("string"), F.lit(":"), c("turn").cast("string"))))


@query(r"""SELECT conv_id, md5(string_agg('[CHUNK_' || right(md5(conv_id || ':' || turn), 8) || ']:' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def prompt_contexts(t: Tables) -> DataFrame:
    """The turns of each conversation as the chunks of a prompt."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "chunk_id", "text")))
    g = _turns(t).groupBy("conv_id").agg(F.transform(rows, lambda x: x["chunk_id"]).alias("ids"), F.transform(rows, lambda x: x["text"]).alias("texts"))
    return g.select("conv_id", F.md5(A.context_text(c("ids"), c("texts"))).alias("digest"))


@query(r"""WITH d AS (SELECT doc_id, source, replace(text, '. ', '.' || chr(10) || '### ') AS x FROM documents),
h AS (SELECT *, list_filter(list_transform(string_split(substr(x, 501), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(13))), lambda l: starts_with(l, '###')) AS r FROM d),
s AS (SELECT *, CASE WHEN length(x) > 500 THEN substr(x, 1, 500) || '...' || CASE WHEN len(r) > 0 THEN chr(10) || array_to_string(r, chr(10)) ELSE '' END ELSE x END AS shown FROM h)
SELECT doc_id, md5(doc_id || '. ' || CASE WHEN doc_id % 3 = 0 THEN split_part(shown, chr(10), 1) || chr(10) || source ELSE shown END || chr(10)) AS digest FROM s""")
def hop_prompts(t: Tables) -> DataFrame:
    """Each document as a numbered chunk of a hop's prompt, its sentences made headers; every third has its source as summary."""
    d = t.documents.withColumn("x", F.replace("text", F.lit(". "), F.lit(".\n### ")))
    return d.select("doc_id", F.md5(A.hop_entry(c("doc_id"), c("x"), F.when(c("doc_id") % 3 == 0, c("source")))).alias("digest"))


@query("""SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split('''' || text || '''', ','), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), lambda x: trim(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '''"')), '|')) AS digest FROM documents""")
def missing_titles(t: Tables) -> DataFrame:
    """The texts between commas, each text in quotes."""
    return t.documents.select("doc_id", F.md5(F.array_join(A.titles(F.concat(F.lit("'"), "text", F.lit("'"))), "|")).alias("digest"))


def _answers(t: Tables) -> DataFrame:
    """An answer in JSON for each conversation; that of every other one has its quotes as JSON text, and one in five has none."""
    k = c("turn") % 3
    q = F.struct(c("role").alias("quote_title"), c("text").alias("quote_text"), F.when(k == 0, "").otherwise(F.concat(F.lit("c"), (c("turn") % 2).cast("string"))).alias("chunk_id"))
    g = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", q.alias("q")))), lambda x: x["q"]).alias("quotes"))
    fields = [F.lit(False).alias("smalltalk"), F.lit("Yes.").alias("short_answer"), F.lit("So.").alias("persona_short_answer"), F.concat(F.lit("of "), c("conv_id").cast("string")).alias("explanation"), F.lit("Done.").alias("persona_afterword")]
    plain, packed = F.to_json(F.struct(*fields, "quotes")), F.to_json(F.struct(*fields, F.to_json("quotes").alias("quotes")))
    return g.select("conv_id", F.when(c("conv_id") % 5 == 4, F.to_json(F.struct(*fields))).when(c("conv_id") % 2 == 0, plain).otherwise(packed).alias("json"))


@query("""WITH k AS (SELECT *, CASE WHEN turn % 3 = 0 THEN '' ELSE 'c' || (turn % 2) END AS chunk FROM conversations WHERE conv_id % 5 <> 4),
m AS (SELECT conv_id, coalesce(nullif(chunk, ''), role) AS k, min(turn) AS a, arg_min(role, turn) AS quote_title, string_agg(text, ' [...] ' ORDER BY turn) AS x FROM k GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY a)::INT AS place, quote_title, md5(x) AS digest FROM m""")
def merged_answer_quotes(t: Tables) -> DataFrame:
    good = A.parsed(_answers(t), "json").where("valid").where(A.checked(c("smalltalk"), c("quotes")))
    return A.merged_quotes(good, "conv_id").select("conv_id", "place", "quote_title", F.md5("quote_text").alias("digest"))


@query("""SELECT conv_id, md5('**Yes.** So.' || chr(10) || chr(10) || string_agg('> **' || role || '**' || chr(10) || '> ' || text || chr(10) || chr(10), '' ORDER BY turn) || '## Explanation' || chr(10) || 'of ' || conv_id || chr(10) || chr(10) || 'Done.') AS digest FROM conversations WHERE conv_id % 5 <> 4 GROUP BY conv_id""")
def answer_markdown(t: Tables) -> DataFrame:
    good = A.parsed(_answers(t), "json").where("valid")
    return good.select("conv_id", F.md5(A.markdown(c("short_answer"), c("persona_short_answer"), c("quotes"), c("explanation"), c("persona_afterword"))).alias("digest"))


#: Answers with faults: what to do to a good one, by doc_id modulo their number, and what is said of it.
BROKEN = [
    ("", ""), ("cut", "json"), ("drop:explanation", "missing:explanation"), ("drop:quotes", "missing:quotes"), ("quotes:{}", "quotes:list"), ("quotes:\"[]\"", ""), ("quotes:\"[1,\"", "quotes:json"), ("quotes:[{\"quote_text\":\"x\"}]", "quote:0"),
    ("quotes:[{\"quote_text\":\"x\",\"quote_title\":\" \"},{\"quote_text\":5,\"quote_title\":\"t\"}]", "blank:0:quote_title,blank:1:quote_text"), ("quotes:[3]", "quote:0"), ("short_answer:\"\"", "blank:short_answer"), ("persona_afterword:null", "blank:persona_afterword"),
    ("quotes:null", "quotes:list"), ("smalltalk:null", ""), ("explanation:[]", ""), ("quotes:\"[] ,\"", ""),
]


def _broken(t: Tables) -> DataFrame:
    """An answer in JSON for each document with keys in order, with the fault of its turn."""
    k = (c("doc_id") % len(BROKEN)).cast("int")
    q = F.array(F.struct(c("source").alias("chunk_id"), c("text").alias("quote_text"), c("lang").alias("quote_title")))
    plain = {"explanation": F.to_json(F.array("text")), "persona_afterword": F.lit('"Done."'), "persona_short_answer": F.lit('"So."'), "quotes": F.to_json(q), "short_answer": F.lit('"Yes."'), "smalltalk": F.lit("false")}
    plain["explanation"] = F.regexp_replace(plain["explanation"], r"^\[|\]$", "")
    fault = F.get(F.array(*(F.lit(x) for x, _ in BROKEN)), k)
    name, value = F.substring_index("fault", ":", 1), F.expr("substring(fault, instr(fault, ':') + 1)")
    rows = t.documents.select("doc_id", "text", fault.alias("fault"), *(x.alias(f"_{n}") for n, x in plain.items()))
    field = lambda n: F.when(c("fault") == f"drop:{n}", None).otherwise(F.concat(F.lit(f'"{n}":'), F.when(name == n, value).otherwise(c(f"_{n}"))))
    whole = F.concat(F.lit("{"), F.concat_ws(",", *(field(n) for n in plain)), F.when(c("fault") == "cut", "").otherwise("}"))
    return rows.select("doc_id", "text", whole.alias("json"))


@query(f"""WITH f(i, x) AS (VALUES {", ".join(f"({k}, '{x}')" for k, (_, x) in enumerate(BROKEN))}) SELECT doc_id, x AS faults, x = '' AS valid, CASE WHEN x IN ('', 'missing:explanation') OR x LIKE 'blank%' OR x LIKE 'quote:%' THEN CASE doc_id % {len(BROKEN)} WHEN 5 THEN 0 WHEN 15 THEN 0 WHEN 8 THEN 2 ELSE 1 END END::INT AS quotes FROM documents JOIN f ON i = doc_id % {len(BROKEN)}""")
def answer_faults(t: Tables) -> DataFrame:
    """What is wrong with the shape of each answer, and how many quotes it has."""
    out = A.parsed(_broken(t), "json")
    return out.select("doc_id", F.array_join("faults", ",").alias("faults"), "valid", F.size("quotes").alias("quotes"))


@query(r"""WITH j AS (SELECT doc_id, to_json({'explanation': text, 'quotes': [{'chunk_id': source, 'quote_text': text, 'quote_title': lang}], 'short_answer': 'Yes.', 'smalltalk': false}) AS x FROM documents WHERE doc_id % 16 = 0)
SELECT doc_id, md5(x::VARCHAR) AS digest FROM j""")
def judge_inputs(t: Tables) -> DataFrame:
    """Good answers as a judge sees them."""
    return _broken(t).where(c("doc_id") % len(BROKEN) == 0).select("doc_id", F.md5(shapes.for_judge(c("json"))).alias("digest"))


PLAIN = [(r"(?s)```(.*?)```", r"\1"), (r"`([^`]+)`", r"\1"), (r"\*\*(.+?)\*\*", r"\1"), (r"__(.+?)__", r"\1"), (r"\*(.+?)\*", r"\1"), (r"_(.+?)_", r"\1"), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"(?m)^#+\s+", ""), (r"(?m)^>\s+", ""), (r"(?m)^[*\-_]{3,}\s*$", "")]
MARKED = "'# ' || replace(replace(text, '. ', '.' || chr(10) || '> **'), ', ', '** _, ``` ') || chr(10) || '---' || chr(10) || '[a](b) `c`'"


def _plain_sql(column: str) -> str:
    for pattern, by in PLAIN:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return column


@query(f"SELECT doc_id, md5({_plain_sql('(' + MARKED + ')')}) AS digest FROM documents")
def plain_markdown(t: Tables) -> DataFrame:
    """Documents with marks put in, and taken off again as for a judge."""
    marked = F.concat(F.lit("# "), F.replace(F.replace("text", F.lit(". "), F.lit(".\n> **")), F.lit(", "), F.lit("** _, ``` ")), F.lit("\n---\n[a](b) `c`"))
    return t.documents.select("doc_id", F.md5(shapes.plain_markdown(marked)).alias("digest"))


FAULTS = ["Quota is gone", "Authentication failed", "Too Many Requests", "content policy", "policy alone", "HTTP 503", "Credit balance; rate limit", "else"]


@query(f"""WITH m(i, x) AS (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(FAULTS))}), e AS (SELECT event_id, lower(x || ' ' || event_type) AS x FROM events JOIN m ON i = event_id % 8)
SELECT event_id, CASE WHEN regexp_matches(x, 'credit balance|insufficient funds|insufficient quota|quota') THEN 'credit' WHEN regexp_matches(x, 'invalid api key|authentication|unauthorized') THEN 'key' WHEN regexp_matches(x, 'rate limit|too many requests') THEN 'rate'
WHEN contains(x, 'content') AND regexp_matches(x, 'filter|policy|safety') THEN 'content' WHEN regexp_matches(x, 'overload|unavailable|temporarily down|503') THEN 'overload' ELSE 'generic' END AS told FROM e""")
def user_messages(t: Tables) -> DataFrame:
    fault = F.get(F.array(*map(F.lit, FAULTS)), (c("event_id") % 8).cast("int"))
    return t.events.select("event_id", A.told(F.concat_ws(" ", fault, "event_type")).alias("told"))


@query("""SELECT doc_id, array_to_string(list_filter(['Ing', 'der', '||', 'QUE'], lambda p: contains(lower(text), lower(p))), ',') AS hits FROM documents""")
def substring_patterns(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(A.hits_of(c("text"), ["Ing", "der", "||", "QUE"]), ",").alias("hits"))


@query(f"""WITH k AS (SELECT conv_id, turn + 1 AS r, {_normal("(role || ' ' || substr(text, 1, 20))")} AS h, {_normal("text")} AS x FROM conversations), g AS (SELECT conv_id, turn, {_normal("substr(text, 5, 12)")} AS t FROM conversations)
SELECT g.conv_id, turn, coalesce(min(CASE WHEN contains(h, t) THEN r END), min(CASE WHEN contains(x, t) THEN r END))::BIGINT AS rank FROM g JOIN k USING (conv_id) GROUP BY g.conv_id, turn""")
def truth_ranks(t: Tables) -> DataFrame:
    """Where a piece of each turn stands among the turns of its conversation, in their headers first."""
    chunks = t.conversations.select("conv_id", (c("turn") + 1).alias("r"), F.concat_ws(" ", "role", F.substring("text", 1, 20)).alias("h"), "text")
    truths = t.conversations.select("conv_id", "turn", F.substring("text", 5, 12).alias("truth"))
    return A.ranked_truths(truths, chunks, "conv_id", "truth", "h", "text", "r").select("conv_id", "turn", "rank")


GIVEN = f"""g AS (SELECT conv_id, turn, {_normal("(role || ' ' || substr(text, 1, 30))")} AS t, CASE turn % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 3 END AS w FROM conversations), q AS (SELECT conv_id, turn AS qt, {_normal("(role || ' ' || text)")} AS x FROM conversations WHERE turn > 0)"""


@query(f"""WITH {GIVEN}, r AS (SELECT g.conv_id, g.turn, any_value(w) AS w, coalesce(bool_or(contains(x, t)), false) AS hit FROM g LEFT JOIN q USING (conv_id) GROUP BY ALL), p AS (SELECT q.conv_id, qt, bool_or(contains(x, t)) AS hit FROM q JOIN g USING (conv_id) GROUP BY ALL)
SELECT conv_id, recall AS quote_recall, coalesce(prec, 0) AS quote_precision FROM (SELECT conv_id, round(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w), 6) AS recall FROM r GROUP BY 1) LEFT JOIN (SELECT conv_id, round(avg(hit::INT), 6) AS prec FROM p GROUP BY 1) USING (conv_id)""")
def quote_recall_precision(t: Tables) -> DataFrame:
    """Beginnings of all turns as truths, all turns but the first as quotes."""
    k = c("turn") % 3
    truths = t.conversations.select("conv_id", F.concat_ws(" ", "role", F.substring("text", 1, 30)).alias("truth"), F.when(k == 0, "critical").when(k == 1, "important").otherwise("supporting").alias("priority"))
    return A.quote_measures(truths, t.conversations.where("turn > 0"), "conv_id", "truth", "priority", "role", "text")


@query(f"""WITH g AS (SELECT conv_id, turn, text, {_normal("text")} AS t FROM conversations WHERE turn > 0), x AS (SELECT conv_id, {_normal("substr(text, 1, 40)")} AS x FROM conversations WHERE turn % 2 = 0)
SELECT conv_id, turn, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS shown FROM g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.conv_id = g.conv_id AND (contains(x, t) OR contains(t, x)))""")
def missing_truth_feedback(t: Tables) -> DataFrame:
    truths = t.conversations.where("turn > 0").select("conv_id", "turn", "text")
    texts = t.conversations.where("turn % 2 = 0").select("conv_id", F.substring("text", 1, 40).alias("x"))
    return A.missing_truths(truths, texts, "conv_id", "text", "x").select("conv_id", "turn", "shown")


@query("""WITH a AS (SELECT DISTINCT p_size AS test, 'a' || p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 3 END AS w FROM part), s AS (SELECT o_custkey % 60 AS test, 'A' || o_orderkey % 7 AS k, o_totalprice / 1000000 AS score FROM orders)
SELECT s.test, round(coalesce(sum(score * w) / sum(w) FILTER (WHERE w IS NOT NULL), 0), 6) AS answer_correctness FROM s LEFT JOIN a ON a.test = s.test AND a.k = lower(s.k) GROUP BY 1""")
def answer_correctness(t: Tables) -> DataFrame:
    """A judge's scores of answers by key, some of keys that no answer has."""
    k = c("p_partkey") % 5
    known = t.part.select(c("p_size").alias("test"), F.concat(F.lit("a"), k.cast("string")).alias("key"), F.when(k == 0, "critical").when(k == 1, "important").otherwise("supporting").alias("priority")).distinct()
    scores = t.orders.select((c("o_custkey") % 60).alias("test"), F.concat(F.lit("A"), (c("o_orderkey") % 7).cast("string")).alias("key"), (c("o_totalprice") / 1000000).alias("score"))
    return A.judged(scores, known, "test", "key", "score", "priority")


@query("SELECT o_orderkey, (o_custkey % 11) / 10 AS score FROM orders WHERE o_custkey % 11 < 10")
def doubtful_answers(t: Tables) -> DataFrame:
    return A.doubtful(t.orders.select("o_orderkey", ((c("o_custkey") % 11) / 10).alias("score")), "score")


@query(r"""WITH m AS (SELECT *, ['text-embedding-3-small', 'text-embedding-3-large', 'text-embedding-ada-002', 'other'][1 + doc_id % 4] AS model, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
SELECT model, CASE model WHEN 'text-embedding-3-large' THEN 3072 ELSE 1536 END AS dims, round(sum(n * CASE model WHEN 'text-embedding-3-large' THEN 0.13 WHEN 'text-embedding-ada-002' THEN 0.1 ELSE 0.02 END / 1000000), 9) AS cost FROM m GROUP BY 1""")
def embedding_costs(t: Tables) -> DataFrame:
    model = F.get(F.array(*map(F.lit, [*A.EMBEDDING, "other"])), (c("doc_id") % 4).cast("int"))
    df = t.documents.select(model.alias("model"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("n"))
    return df.groupBy("model", A.dimensions(c("model")).alias("dims")).agg(F.round(F.sum(A.embedding_cost(c("n"), c("model"))), 9).alias("cost"))


@query("SELECT p_partkey, coalesce(h, 0)::INT AS hop FROM part LEFT JOIN (SELECT l_partkey, min(l_linenumber) AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey")
def chunk_hops(t: Tables) -> DataFrame:
    hops = t.lineitem.where("l_returnflag = 'R'").groupBy(c("l_partkey").alias("p_partkey")).agg(F.min("l_linenumber").alias("hop"))
    return A.with_hop(t.part.select("p_partkey"), hops, "p_partkey", "hop")


@query("SELECT l_partkey, min(l_linenumber) AS hop FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def pruned_hops(t: Tables) -> DataFrame:
    hops = t.lineitem.groupBy("l_partkey").agg(F.min("l_linenumber").alias("hop"))
    return A.kept_hops(hops, t.part.where("p_size > 25").select(c("p_partkey").alias("l_partkey")), "l_partkey")


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), s AS (SELECT conv_id, 1 + turn % 3 AS n, arg_max(md5(text), turn) AS summary FROM conversations GROUP BY ALL)
SELECT conv_id, turn, summary FROM n LEFT JOIN s USING (conv_id, n)""")
def summaries_by_ordinal(t: Tables) -> DataFrame:
    """Turns with the summaries of their ordinals, of which some come several times."""
    s = t.conversations.select("conv_id", (1 + c("turn") % 3).alias("n"), F.md5("text").alias("s"), c("turn").alias("o"))
    return A.with_summary(t.conversations.select("conv_id", "turn"), s, "conv_id", "turn", "n", "s", "o")


@query("""WITH f AS (SELECT left(md5(o_orderkey::VARCHAR), 3) AS p, arg_min(md5(o_orderkey::VARCHAR), o_orderkey) AS found FROM orders GROUP BY 1)
SELECT c_custkey, found FROM customer JOIN f ON p = left(md5(c_custkey || 'x'), 3)""")
def feedback_by_prefix(t: Tables) -> DataFrame:
    full = t.orders.select(F.md5(c("o_orderkey").cast("string")).alias("id"), "o_orderkey")
    short = t.customer.select("c_custkey", F.left(F.md5(F.concat(c("c_custkey").cast("string"), F.lit("x"))), F.lit(3)).alias("p"))
    return A.by_prefix(short, "p", full, "id", "o_orderkey", 3).select("c_custkey", "found")


@query("""WITH s AS (SELECT p_name AS name, min(p_type) AS summary FROM part WHERE p_size % 2 = 0 GROUP BY 1) SELECT p_partkey, summary FROM part LEFT JOIN s ON name = p_name""")
def header_summaries(t: Tables) -> DataFrame:
    """Headers that begin with their brand, joined with summaries by the rest."""
    heads = t.part.select("p_partkey", hierarchy.without_parent(F.concat_ws(" - ", "p_brand", "p_name"), c("p_brand")).alias("name"))
    return heads.join(t.part.where("p_size % 2 = 0").groupBy(c("p_name").alias("name")).agg(F.min("p_type").alias("summary")), "name", "left").select("p_partkey", "summary")


@query("""WITH l AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE max(o_orderdate) END AS d FROM orders GROUP BY 1), f AS (SELECT o_custkey AS k, max(o_orderdate) AS h FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT k, CASE WHEN h IS NULL THEN 'new' WHEN d IS NULL THEN 'undated' WHEN d > h THEN 'updated' ELSE 'current' END AS why FROM l LEFT JOIN f USING (k)""")
def listing_freshness(t: Tables) -> DataFrame:
    """Customers' last orders as a listing, their last closed ones as the files that are there."""
    listed = t.orders.groupBy(c("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("d")).withColumn("d", F.when(c("k") % 11 != 0, c("d")))
    return A.freshness(listed, t.orders.where("o_orderstatus <> 'O'").groupBy(c("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("h")), "k", "d", "h").select("k", "why")


@query("""WITH o AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), n AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) SELECT w AS word, o.w IS NULL AS added FROM o FULL JOIN n USING (w)""")
def keywords_added(t: Tables) -> DataFrame:
    old = t.part.select(F.explode(F.split("p_name", " ")).alias("word"))
    return A.added(old, t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word")), "word")


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS requests, sum(l_quantity) AS total_tokens, round(sum(l_tax), 4) AS total_cost, round(avg(l_quantity), 6) AS mean_tokens, round(avg(l_tax), 6) AS mean_cost FROM lineitem GROUP BY ALL")
def token_totals(t: Tables) -> DataFrame:
    return evaluation.token_summary(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", "l_tax")


@query("SELECT count(*)::BIGINT AS n, round(avg(l_discount), 6) AS mean_confidence, round(avg(l_tax), 6) AS mean_relevance, round(avg((l_returnflag = 'A')::INT), 6) AS pass_rate FROM lineitem")
def confidence_means(t: Tables) -> DataFrame:
    return evaluation.confidence_summary(t.lineitem, "l_discount", "l_tax", c("l_returnflag") == "A")


@query("SELECT user_id, count(*)::BIGINT AS n, count_if(event_type = 'error')::BIGINT AS errors, count_if(event_type = 'error' AND value > 10)::BIGINT AS recovered FROM events GROUP BY 1")
def error_log_counts(t: Tables) -> DataFrame:
    return evaluation.error_counts(t.events, "user_id", c("event_type") == "error", c("value") > 10)


@query("SELECT conv_id, count(*) <= 10 AND conv_id % 4 > 0 AS ok, CASE WHEN count(*) > 10 AND conv_id % 4 = 0 THEN 'messages,ttl' WHEN count(*) > 10 THEN 'messages' WHEN conv_id % 4 = 0 THEN 'ttl' ELSE '' END AS broken, count(*) * 60 < 600 AS expired, bool_and(trim(text) <> '') AS complete FROM conversations GROUP BY 1")
def conversation_invariants(t: Tables) -> DataFrame:
    """Messages and time to live of conversations, each begun so many minutes before the time of asking as it has turns."""
    g = t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages")).withColumn("ttl", c("conv_id") % 4)
    broken = I.broken(I.conversation_rules("messages", "ttl"))
    now = datetime(2024, 1, 1)
    late = I.conversation_expired(F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - 600_000_000), c("messages") * 60, now)
    return g.join(I.complete(t.conversations, "conv_id", "text"), "conv_id").select("conv_id", (F.size(broken) == 0).alias("ok"), F.array_join(broken, ",").alias("broken"), late.alias("expired"), "complete")


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_type = 'view' THEN 'completed' END, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'errors' END, CASE WHEN coalesce(value, 0) < 5 THEN 'tokens' END) AS broken FROM events""")
def job_invariants(t: Tables) -> DataFrame:
    failed = c("event_type") == "error"
    df = t.events.select(
        "event_id", "ts", F.when(c("event_type") == "view", F.date_sub("ts", 1).cast("timestamp")).when(~failed, c("ts")).alias("done"), F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed & (c("user_id") % 2 == 1), F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("errors"), (F.coalesce("value", F.lit(0.0)) - 5).alias("tokens"),
    )
    return df.select("event_id", F.array_join(I.broken(I.job_rules("ts", "done", "status", "errors", "tokens")), ",").alias("broken"))


TITLES = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '**' || p_name || '** - TAC OP -  security ' WHEN 1 THEN p_name || ' - Strategy Ploy' WHEN 2 THEN p_name || ' - Faction Equipment' WHEN 3 THEN 'FAQ - ' || p_name WHEN 4 THEN p_name || ' - Archetypes' WHEN 5 THEN 'Operative Selection' WHEN 6 THEN p_brand || ' - ' || p_name WHEN 7 THEN p_name || ' - Tac Op - Recon - TAC OP - RECON' ELSE p_name || ' - Equipment' END AS title FROM part"


def _titles(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.expr(TITLES.split("p_partkey, ", 1)[1].split(" AS title")[0]).alias("title"))


@query(f"""WITH x AS ({TITLES}) SELECT p_partkey, CASE p_partkey % 9 WHEN 1 THEN 'Strategy Ploys' WHEN 2 THEN 'Faction Equipment' WHEN 0 THEN 'Operatives' WHEN 4 THEN 'Faction Rules' WHEN 5 THEN 'Operative Selection' WHEN 6 THEN 'Operatives' WHEN 7 THEN 'Operatives' END AS category,
CASE p_partkey % 9 WHEN 0 THEN 'SECURITY' END AS archetype, CASE p_partkey % 9 WHEN 0 THEN regexp_extract(title, '^\\*\\*(.*)\\*\\* - TAC OP', 1) END AS tac_op,
trim(replace(CASE WHEN p_partkey % 9 IN (1, 2) THEN regexp_replace(title, ' - (Strategy Ploy|Faction Equipment)$', '') ELSE title END, '*', '')) AS cleaned FROM x""")
def title_rules(t: Tables) -> DataFrame:
    """Titles of all kinds with their category, archetype and clean form."""
    x = c("title")
    return _titles(t).select("p_partkey", F.nullif(hierarchy.category(x), F.lit("")).alias("category"), hierarchy.archetype(x).alias("archetype"), hierarchy.tac_op_name(x).alias("tac_op"), hierarchy.cleaned(x).alias("cleaned"))


@query("""SELECT doc_id, source AS version, CASE WHEN doc_id % 4 > 0 THEN make_date(2024, 1 + (doc_id % 12)::INT, 3) END AS updated, doc_id % 3 > 0 AS known FROM documents WHERE source IS NOT NULL""")
def documents_from_front(t: Tables) -> DataFrame:
    """A document's fields from its frontmatter."""
    day = F.when(c("doc_id") % 4 > 0, F.format_string("2024-%02d-03", 1 + c("doc_id") % 12)).otherwise("soon")
    md = t.documents.where("source is not null").select("doc_id", F.concat(F.lit("---\nsource: "), "source", F.lit("\nlast_update_date: "), day, F.lit("\ndocument_type: "), F.when(c("doc_id") % 3 > 0, "faq").otherwise("poem"), F.lit("\n---\n"), "text").alias("md"))
    return chunking.document_fields(md, "md").select("doc_id", "version", "updated", "known")


@query()
def team_filter(t: Tables) -> DataFrame:
    """The structure of the brands that queries mean, by names, abilities, aliases (part types) and likeness of brand names."""
    from .retrieval import _entity_queries

    q, table = _entity_queries(t), terms.entity_table(t.part, "p_name", "p_brand")
    named = [terms.matched_teams(q, table, "item_id", "text", rule).select("item_id", F.explode("teams").alias("team")) for rule in (terms.names_match, terms.abilities_match)]
    alias = terms.alias_teams(q, t.part.select(F.lower("p_type").alias("alias"), "p_brand").distinct(), "item_id", "text", "alias", "p_brand")
    like = terms.fuzzy_teams(q, t.part.select(F.lower("p_brand").alias("b")).distinct(), "item_id", "text", "b").select("item_id", "team")
    teams = terms.all_teams([*named, alias, like], "item_id")
    return terms.structure_of(t.part.groupBy("p_brand").agg(F.count("*").alias("items")), teams, "p_brand")


ENDINGS = ["", "s", "ies", "y", "es", "xes", "x", "sses"]
_END = "[" + ", ".join(f"'{x}'" for x in ENDINGS) + "]"


def _singular_sql(x: str) -> str:
    last = f"string_split({x}, ' ')[-1]"
    return f"""CASE WHEN {last} LIKE '%IES' AND length({last}) > 3 THEN left({x}, length({x}) - 3) || 'Y' WHEN {last} LIKE '%ES' AND length({last}) > 2 THEN CASE WHEN regexp_matches({last}, '(CH|SH|SS|X|Z)ES$') THEN left({x}, length({x}) - 2) ELSE left({x}, length({x}) - 1) END
WHEN {last} LIKE '%S' AND length({last}) > 1 THEN left({x}, length({x}) - 1) ELSE {x} END"""


@query(f"""WITH a AS (SELECT p_partkey, p_type, replace(p_name, ' ', '_') || {_END}[1 + p_partkey % 8] AS team, upper(replace(p_name, ' ', '-')) || upper({_END}[1 + (p_partkey // 8) % 8]) AS head FROM part),
b AS (SELECT *, upper(replace(team, '_', ' ')) AS t, replace(head, '-', ' ') AS h FROM a), s AS (SELECT *, t = h OR ({_singular_sql("t")}) = ({_singular_sql("h")}) AS same FROM b)
SELECT p_partkey, CASE WHEN same THEN p_type ELSE head || ' - ' || p_type END AS rest, array_to_string(list_transform(string_split(replace(team, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS key FROM s""")
def team_prefixes(t: Tables) -> DataFrame:
    """Headers that begin with a part's name in capitals with hyphens and some ending, for teams that are written with underscores and another."""
    ending = lambda k: F.get(F.array(*map(F.lit, ENDINGS)), k.cast("int"))
    k = c("p_partkey")
    rows = t.part.select("p_partkey", "p_type", F.concat(F.translate("p_name", " ", "_"), ending(k % 8)).alias("team"), F.upper(F.concat(F.translate("p_name", " ", "-"), ending(F.floor(k / 8) % 8))).alias("head"))
    key = hierarchy.readable_key(c("team"))
    return rows.select("p_partkey", hierarchy.without_team(F.concat_ws(" - ", "head", "p_type"), key).alias("rest"), key.alias("key"))


@query(f"""WITH a AS (SELECT p_partkey, p_type, p_size, replace(p_name, ' ', '_') || {_END}[1 + p_partkey % 2] AS team, upper(replace(p_name, ' ', '-')) || upper({_END}[1 + p_size % 2]) AS head FROM part),
b AS (SELECT *, upper(replace(team, '_', ' ')) AS t, replace(head, '-', ' ') AS h FROM a), s AS (SELECT *, {_singular_sql("t")} AS st, {_singular_sql("h")} AS sh FROM b),
k AS (SELECT st, p_type AS key, max('of ' || p_partkey) AS summary FROM s WHERE p_partkey % 3 = 0 GROUP BY ALL)
SELECT p_partkey, summary FROM s LEFT JOIN k ON k.st = s.st AND key = CASE WHEN t = h OR s.st = sh THEN p_type ELSE head || ' - ' || p_type END""")
def team_summaries(t: Tables) -> DataFrame:
    """Headers with their team's name in front, joined with the summaries of teams that may be written in another way."""
    ending = lambda k: F.get(F.array(*map(F.lit, ENDINGS)), (k % 2).cast("int"))
    rows = t.part.select("p_partkey", "p_type", F.concat(F.translate("p_name", " ", "_"), ending(c("p_partkey"))).alias("team"), F.upper(F.concat(F.translate("p_name", " ", "-"), ending(c("p_size")))).alias("head"))
    known = rows.where("p_partkey % 3 = 0").select("team", "p_type", F.concat(F.lit("of "), "p_partkey").alias("summary"))
    titles = rows.select("p_partkey", "team", F.concat_ws(" - ", "head", "p_type").alias("title"))
    return hierarchy.with_team_summary(titles, known, "title", "team", "p_type", "summary").select("p_partkey", "summary")
