"""Queries over search, fusion, measures, terms and entities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..operators import bm25, chunking, fusion, grounding, metrics, sizes, terms, vectors
from ..plans import retrieval
from ..sources.scratch import saved
from .base import Tables, query
from .texts import NORMAL

TOK = r"'[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?'"
INDEX = f"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), {TOK}) AS w FROM documents),
post AS (SELECT id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT id, unnest(w) AS term, len(w) AS size FROM w) GROUP BY id, term),
tot AS (SELECT count(*) AS docs, avg(len(w)) AS mean_size FROM w), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, tot),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def bm25_sql(k1: float = 1.6, b: float = 0.8, k: int = 15) -> str:
    return f"""{INDEX},
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(times * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * size / mean_size))), 6) AS score FROM asked JOIN terms USING (term) JOIN post USING (term), tot GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= {k} AND score > 0)"""


def _bm25(t: Tables, k: int = 15) -> DataFrame:
    return bm25.search(t.benchmark, t.documents, k, "item_id", "text", "doc_id", "text")


@query(f"WITH {bm25_sql()} SELECT query_id, id, score, rank::INT AS rank FROM bm")
def bm25_search_top15(t: Tables) -> DataFrame:
    return _bm25(t)


@query(f"WITH {INDEX} SELECT docs::BIGINT AS chunk_count, round(mean_size, 6) AS avg_doc_length, (SELECT count(*) FROM terms)::BIGINT AS vocabulary_size FROM tot")
def bm25_index_stats(t: Tables) -> DataFrame:
    i = bm25.index(t.documents, "doc_id", "text")
    return i.totals.crossJoin(i.terms.agg(F.count("*").alias("vocabulary_size"))).select(F.col("docs").alias("chunk_count"), F.round("mean_size", 6).alias("avg_doc_length"), "vocabulary_size")


@query(f"WITH {INDEX} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM terms ORDER BY df DESC, term LIMIT 100")
def bm25_term_df_topk(t: Tables) -> DataFrame:
    return bm25.index(t.documents, "doc_id", "text").terms.select("term", "df", F.round("idf", 6).alias("idf")).orderBy(F.desc("df"), "term").limit(100)


VEC = """vec AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(greatest(0.0, 1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) / 2), 6) AS similarity
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM vec) WHERE rank <= 15)"""


def _vectors(t: Tables, k: int = 15) -> DataFrame:
    return vectors.nearest(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, k, "vec_id", "embedding", "vec_id", "embedding")


@query(f"WITH {VEC} SELECT query_id, id, similarity, rank::INT AS rank FROM vr WHERE similarity >= 0.2")
def vector_topk_similarity(t: Tables) -> DataFrame:
    return vectors.at_least(_vectors(t), 0.2)


LABEL_RANK = "lr AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(q.vec_id - v.vec_id), v.vec_id) AS rank FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0) WHERE rank <= 30)"
RRF = f"""{VEC}, {LABEL_RANK}, un AS (SELECT query_id, id, vr.rank AS vector_rank, lr.rank AS text_rank, similarity, round(coalesce(0.5 / (60 + vr.rank), 0) + coalesce(0.5 / (60 + lr.rank), 0), 9) AS rrf FROM vr FULL JOIN lr USING (query_id, id)),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM un) WHERE rank <= 15),
rel AS (SELECT *, round(0.45 + (rrf - min(rrf) OVER p) / CASE WHEN max(rrf) OVER p > min(rrf) OVER p THEN max(rrf) OVER p - min(rrf) OVER p ELSE 1 END * 0.55, 6) AS relevance FROM fu WINDOW p AS (PARTITION BY query_id))"""


#: How many neighbours by id are looked at on each side.
AROUND = 30


def _fused(t: Tables) -> DataFrame:
    """Vectors fused with the nearest ids of the same label: those have places among their label, so a query meets AROUND rows on each side."""
    from pyspark.sql import Window

    e = sizes.placed(t.embeddings.select(F.col("vec_id").alias("id"), "label"), ["label"], "id", F.lit(1)).withColumnRenamed("before", "at")
    around = F.explode(F.sequence(F.col("at") - AROUND, F.col("at") + AROUND)).alias("at")
    q = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "label", around)
    order = Window.partitionBy("query_id").orderBy(F.abs(F.col("query_id") - F.col("id")), "id")
    near = q.join(e, ["label", "at"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= AROUND).withColumn("score", F.lit(1.0))
    return fusion.hybrid(_vectors(t), near, 15)


@query(f"WITH {RRF} SELECT query_id, id, vector_rank::INT AS vector_rank, text_rank::INT AS text_rank, similarity, rrf, relevance, rank::INT AS rank FROM rel")
def rrf_fusion_normalized(t: Tables) -> DataFrame:
    return _fused(t).drop("text_score")


@query(f"""WITH {RRF}, g AS (SELECT *, avg(relevance) OVER (PARTITION BY query_id) AS m FROM rel)
SELECT query_id, list(id ORDER BY rank)::VARCHAR AS ids, count(*)::BIGINT AS total, round(avg(relevance), 6) AS mean_score, round(avg(relevance), 6) >= 0.6 AS meets FROM g WHERE m >= 0.55 GROUP BY query_id""")
def context_threshold_gate(t: Tables) -> DataFrame:
    c = fusion.contexts(fusion.gated(_fused(t), "relevance", 0.55), "relevance", 0.6)
    return c.withColumn("ids", F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]")))


@query(f"""WITH {RRF}, both_hops AS (SELECT query_id, id, relevance AS score, rank AS ordinal FROM rel UNION ALL SELECT query_id, id, round(relevance - 0.01, 6), 1000 + rank FROM rel WHERE rank % 2 = 0 UNION ALL SELECT query_id, id + 1000000, round(relevance - 0.02, 6), 2000 + rank FROM rel),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY ordinal) AS n FROM both_hops) WHERE n = 1)
SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM once) WHERE rank <= 20""")
def final_rerank_top20(t: Tables) -> DataFrame:
    """The fused list, part of it again from a second hop, and other ids, once each and cut at 20."""
    f = _fused(t)
    parts = [(F.lit(True), 0, 0.0, 0), (F.col("rank") % 2 == 0, 0, 0.01, 1000), (F.lit(True), 1_000_000, 0.02, 2000)]
    own = (F.when(there, F.struct((F.col("id") + shift).alias("id"), F.round(F.col("relevance") - less, 6).alias("score"), (F.col("rank") + at).alias("ordinal"))) for there, shift, less, at in parts)
    hits = f.select("query_id", F.explode(F.array(*own)).alias("hit")).where("hit is not null").select("query_id", "hit.*")
    return fusion.reranked(hits, "score", "ordinal", 20).select("query_id", "id", "score", "rank")


RANKS = f"WITH {VEC}, tr AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0), tk AS (SELECT tr.query_id, vr.rank FROM tr LEFT JOIN vr USING (query_id, id)), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS LAST) AS i FROM tk)"
MEASURES = f"""{RANKS}, ms AS (SELECT query_id, round(coalesce(sum(i / rank), 0) / count(*), 6) AS average_precision, round(count_if(rank <= 5) / count(*), 6) AS recall_at_k, round(count(rank) / count(*), 6) AS recall,
round(count_if(rank <= 3) / 3, 6) AS precision_at_k, round(coalesce(1 / min(rank), 0), 6) AS reciprocal_rank FROM n GROUP BY query_id)"""


def _measures(t: Tables) -> DataFrame:
    """All vectors of a query's label are its truths: they are counted by label, and only hits are rows."""
    e = t.embeddings
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    totals = q.join(e.groupBy("label").agg(F.count("*").alias("truths")), "label")
    same = _vectors(t).join(e.select(F.col("vec_id").alias("id"), "label"), "id").join(q, ["query_id", "label"], "left_semi")
    return metrics.measures_of_hits(same.select("query_id", "rank"), totals.select("query_id", "truths"))


@query(f"{MEASURES} SELECT * FROM ms")
def ir_metrics_per_query(t: Tables) -> DataFrame:
    return _measures(t)


@query(f"""{MEASURES} SELECT count(*)::BIGINT AS queries, {", ".join(f"round(avg({x}), 6) AS mean_{x}, round(coalesce(stddev_samp({x}), 0), 6) AS std_{x}" for x in ("average_precision", "recall_at_k", "recall", "precision_at_k", "reciprocal_rank"))} FROM ms""")
def ir_metrics_macro(t: Tables) -> DataFrame:
    return metrics.macro(_measures(t))


GT = f"gt AS (SELECT item_id, {NORMAL} AS g, CASE item_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'important' ELSE 'supporting' END AS priority FROM benchmark), dn AS (SELECT doc_id, source, {NORMAL} AS x FROM documents)"


def _truths(t: Tables) -> DataFrame:
    k = F.col("item_id") % 3
    return t.benchmark.select("item_id", F.col("text").alias("truth"), F.when(k == 0, "critical").when(k == 1, "important").otherwise("supporting").alias("priority"))


@query(f"""WITH {GT}, hit AS (SELECT item_id, priority, bool_or(contains(x, g)) AS found, min(CASE WHEN contains(x, g) THEN doc_id END) AS first_doc FROM gt, dn GROUP BY item_id, priority)
SELECT item_id, priority, found, first_doc FROM hit""")
def ground_truth_hits(t: Tables) -> DataFrame:
    found = metrics.found_in(_truths(t), t.documents, "truth", "text").groupBy("item_id").agg(F.min("doc_id").alias("first_doc"))
    return _truths(t).join(found, "item_id", "left").select("item_id", "priority", F.col("first_doc").isNotNull().alias("found"), "first_doc")


@query(f"""WITH {GT}, wt AS (SELECT item_id % 4 AS query_id, CASE priority WHEN 'critical' THEN 10 WHEN 'important' THEN 5 ELSE 3 END AS w, (SELECT bool_or(contains(x, g)) FROM dn) AS found FROM gt)
SELECT query_id::BIGINT AS query_id, round(sum(CASE WHEN found THEN w ELSE 0 END) / sum(w), 6) AS context_recall FROM wt GROUP BY query_id""")
def weighted_context_recall(t: Tables) -> DataFrame:
    hit = metrics.found_in(_truths(t), t.documents, "truth", "text").select("item_id").distinct().withColumn("found", F.lit(True))
    w = metrics.weight(F.col("priority"))
    df = _truths(t).join(hit, "item_id", "left").groupBy((F.col("item_id") % 4).alias("query_id"))
    return df.agg(F.round(F.sum(F.when(F.col("found"), w).otherwise(0)) / F.sum(w), 6).alias("context_recall"))


@query(f"""WITH {GT} SELECT source, round(avg((EXISTS (SELECT 1 FROM gt WHERE contains(x, g)))::INT), 6) AS context_precision, count(*)::BIGINT AS contexts FROM dn GROUP BY source""")
def context_precision(t: Tables) -> DataFrame:
    hit = metrics.found_in(_truths(t), t.documents, "truth", "text").select("doc_id").distinct().withColumn("hit", F.lit(1))
    return t.documents.select("doc_id", "source").join(hit, "doc_id", "left").groupBy("source").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("context_precision"), F.count("*").alias("contexts"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS ac, l_tax * 10 AS qf, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity / 50 END AS qr, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.5 END AS qp, CASE WHEN l_returnflag = 'A' THEN NULL ELSE 0.25 END AS cr, l_returnflag = 'R' AND l_linenumber = 1 AS bad FROM lineitem),
b AS (SELECT *, CASE WHEN bad THEN 0 ELSE (coalesce(ac, 0) * 0.50 + coalesce(qf, 0) * 0.20 + coalesce(qr, 0) * 0.15 + coalesce(qp, 0) * 0.10 + coalesce(cr, 0) * 0.05) / (0.5 + 0.2 + CASE WHEN qr IS NULL THEN 0 ELSE 0.15 END + 0.1 + CASE WHEN cr IS NULL THEN 0 ELSE 0.05 END) * 100 END AS s FROM a),
c AS (SELECT *, round(s, 6) AS score FROM b)
SELECT CASE WHEN bad THEN 'error' WHEN score >= 80 THEN 'passed' WHEN score < 50 THEN 'failed' ELSE 'partial' END AS status, count(*)::BIGINT AS n, round(avg(score), 4) AS mean_score, sum(floor(score))::BIGINT AS stored FROM c GROUP BY 1""")
def aggregate_score_weighted(t: Tables) -> DataFrame:
    c = F.col
    parts = {
        "answer_correctness": c("l_discount") * 10, "quote_faithfulness": c("l_tax") * 10, "quote_recall": F.when(c("l_linenumber") % 3 != 0, c("l_quantity") / 50),
        "quote_precision": F.when(c("l_linestatus") == "O", 1.0).otherwise(0.5), "context_recall": F.when(c("l_returnflag") != "A", 0.25),
    }
    bad = (c("l_returnflag") == "R") & (c("l_linenumber") == 1)
    df = t.lineitem.select(F.round(metrics.answer_score(parts, bad), 6).alias("score"), bad.alias("bad"))
    return df.groupBy(metrics.status(c("score"), c("bad")).alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.sum(F.floor("score")).cast("long").alias("stored"))


# -- terms -------------------------------------------------------------------------------

HEAD = "SELECT doc_id, trim(split_part(text, chr(10), 1), ' ' || chr(9) || chr(13)) AS h FROM documents"
KEYWORDS = rf"""hd AS ({HEAD}), kw AS (SELECT DISTINCT unnest(CASE WHEN regexp_matches(h, '^([A-Z][a-z]+)(\s+[x\d+]+)?$') THEN list_filter([regexp_extract(h, '^([A-Z][a-z]+)', 1)], lambda w: length(w) >= 4)
 WHEN contains(h, ' - ') THEN list_filter(string_split_regex(h, '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND length(w) >= 4)
 ELSE list_filter(string_split_regex(h, '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND length(w) >= 4 AND regexp_matches(w, '^\p{{L}}+$')) END) AS keyword FROM hd WHERE h <> '')"""


def _first_line():
    return T.trim_all(F.split_part("text", F.lit("\n"), F.lit(1)))


def _keywords(t: Tables) -> DataFrame:
    heads = t.documents.select(_first_line().alias("h"), F.lit("").alias("x"))
    return terms.keywords(heads, "h", "x")


@query(f"WITH {KEYWORDS} SELECT keyword FROM kw")
def keyword_extract(t: Tables) -> DataFrame:
    """Keywords of the first lines of all documents, taken as headers."""
    return _keywords(t)


@query(rf"""WITH {KEYWORDS}, cs AS (SELECT lower(keyword) AS low, min(keyword) AS keyword FROM kw GROUP BY 1),
q AS (SELECT item_id, unnest(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ')) AS word, generate_subscripts(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1) AS i FROM benchmark),
b AS (SELECT item_id, i, word, trim(word, '.,!?;:()[]{{}}"''-') AS bare FROM q)
SELECT item_id, string_agg(CASE WHEN keyword IS NULL THEN word ELSE replace(word, bare, keyword) END, ' ' ORDER BY i) AS normalised FROM b LEFT JOIN cs ON low = bare GROUP BY item_id""")
def query_normalize(t: Tables) -> DataFrame:
    return terms.normalised(t.benchmark.withColumn("text", F.lower("text")), _keywords(t), "item_id", "text")


#: A small dictionary of common words, for want of a table of synonyms.
SYNONYMS = [("and", "conjunction"), ("that", "pronoun"), ("the", "article"), ("of the", "genitive"), ("und", "conjunction"), ("les", "article"), ("with", "preposition"), ("in the", "locative")]


@query(f"""WITH s(synonym, term) AS (VALUES {", ".join(map(str, SYNONYMS))}), m AS (SELECT item_id, string_agg(DISTINCT term, ' ' ORDER BY term) AS x FROM benchmark, s WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || synonym || '($|[^\\p{{L}}\\p{{N}}_])') GROUP BY item_id)
SELECT item_id, text || coalesce(' ' || x, '') AS expanded FROM benchmark LEFT JOIN m USING (item_id)""")
def synonym_expand(t: Tables) -> DataFrame:
    words = t.benchmark.sparkSession.createDataFrame(SYNONYMS, "synonym string, term string")
    return terms.expanded(t.benchmark, words, "item_id", "text")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in terms.STOP_WORDS) + "]"
ROLE_SQL = "[" + ", ".join(f"'{w}'" for w in terms.ROLE_WORDS) + "]"
ENTITY = f"""en AS (SELECT lower(p_name) AS entity, list_sort(list_distinct(list(p_brand))) AS teams FROM part GROUP BY 1),
ew AS (SELECT *, list_filter(string_split_regex(trim(entity), '\\s+'), lambda w: NOT list_contains({STOP_SQL}, w) AND w <> '') AS words FROM en),
er AS (SELECT *, len(list_filter(words, lambda w: list_contains({ROLE_SQL}, w))) > 0 AS has_role, len(words) AS n FROM ew),
qs AS (SELECT item_id, lower(text) || ' ' || lower((SELECT string_agg(p_name, ' ' ORDER BY p_partkey) FROM part WHERE p_partkey BETWEEN item_id AND item_id + 1)) AS q FROM benchmark),
pr AS (SELECT *, list_filter(words, lambda w: length(w) >= 4 AND contains(q, w)) AS hits FROM er, qs),
st AS (SELECT *, len(list_filter(hits, lambda w: length(w) >= 6 AND NOT list_contains({ROLE_SQL}, w))) > 0 AS strong FROM pr)"""


def _entity_queries(t: Tables) -> DataFrame:
    q = t.benchmark.select("item_id", "text")
    names = t.part.select("p_partkey", "p_name", F.explode(F.array(F.col("p_partkey"), F.col("p_partkey") - 1)).alias("item_id"))
    near = q.join(names, "item_id").groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), " ").alias("names"))
    return q.join(near, "item_id").select("item_id", F.concat_ws(" ", "text", "names").alias("text"))


@query(f"""WITH {ENTITY}, ok AS (SELECT item_id, teams FROM st WHERE length(entity) >= 4 AND CASE WHEN n <= 2 AND has_role THEN n > 0 AND contains(q, array_to_string(words, ' ')) ELSE NOT (n >= 3 AND has_role AND NOT strong) AND len(hits) >= CASE WHEN n >= 3 AND NOT strong THEN 2 ELSE 1 END END),
ex AS (SELECT DISTINCT item_id, unnest(teams) AS team FROM ok) SELECT item_id, string_agg(team, ',' ORDER BY team) AS teams FROM ex GROUP BY item_id""")
def entity_match_names(t: Tables) -> DataFrame:
    """Brands whose part names are meant by a query made of a benchmark text and two part names."""
    table = terms.entity_table(t.part, "p_name", "p_brand")
    return terms.matched_teams(_entity_queries(t), table, "item_id", "text").select("item_id", F.array_join("teams", ",").alias("teams"))


@query(f"""WITH {ENTITY}, ex AS (SELECT DISTINCT item_id, unnest(teams) AS team FROM st WHERE n > 0 AND len(hits) >= CASE WHEN n = 1 THEN 1 ELSE 2 END) SELECT item_id, string_agg(team, ',' ORDER BY team) AS teams FROM ex GROUP BY item_id""")
def entity_match_abilities(t: Tables) -> DataFrame:
    table = terms.entity_table(t.part, "p_name", "p_brand")
    return terms.matched_teams(_entity_queries(t), table, "item_id", "text", terms.abilities_match).select("item_id", F.array_join("teams", ",").alias("teams"))


@query()
def fuzzy_header_match(t: Tables) -> DataFrame:
    """The document whose first line is most like, at 85, the first line of a benchmark text, or that of every twentieth document without
    each seventh character; the latter are asked under -1 less the document's id."""
    heads = saved(t.documents.select("doc_id", _first_line().alias("h")))
    damaged = heads.where("doc_id % 20 = 0").select((-1 - F.col("doc_id")).alias("item_id"), F.regexp_replace("h", "(.{6}).", "$1").alias("q"))
    asked = saved(t.benchmark.select("item_id", _first_line().alias("q")).union(damaged))
    return terms.header_lookup(asked, heads, "item_id", "q", "doc_id", "h", "doc_id")


@query()
def fuzzy_team_names(t: Tables) -> DataFrame:
    """Words of every twentieth part's name without their third letter, and the words of all names that are like them at 80."""
    asked = t.part.where("p_partkey % 20 = 0").select("p_partkey", F.regexp_replace("p_name", r"(\w\w)\w(\w)", "$1$2").alias("text"))
    return terms.fuzzy_teams(asked, t.part.select(F.explode(F.split("p_name", " ")).alias("name")), "p_partkey", "text", "name")


@query()
def quote_grounding(t: Tables) -> DataFrame:
    """Benchmark texts as quotes against the three best documents of each."""
    best = _bm25(t, 3).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))
    texts = best.join(t.documents.select("doc_id", "text"), "doc_id")
    return grounding.grounded(t.benchmark.select("item_id", "text"), texts.select("item_id", "doc_id", "text").withColumnRenamed("text", "body"), "item_id", "text", "item_id", "doc_id", "body")


@query(r"""WITH q AS (SELECT item_id, '(?is)\s*' || array_to_string(list_transform(string_split_regex(trim(text, ' ' || chr(10)), '\s+'), lambda x: regexp_escape(x)), '\s+') AS p FROM benchmark),
f AS (SELECT item_id, doc_id, regexp_extract(text, p || '.{0,100}') AS shown, text FROM q, documents WHERE regexp_matches(text, p))
SELECT item_id, doc_id, strpos(text, shown) - 1 AS start, shown FROM f""")
def quote_spans(t: Tables) -> DataFrame:
    """Where each document has a benchmark text, and what is shown of it."""
    pairs = metrics.found_in(t.benchmark.select("item_id", F.col("text").alias("quote")), t.documents.select("doc_id", "text"), "quote", "text")
    both = pairs.select("item_id", "quote", "doc_id", "text").withColumn("key", F.struct("item_id", "doc_id"))
    found = grounding.located(both.select("item_id", "quote", "key"), both.select("key", "doc_id", "text"), "item_id", "quote", "key", "doc_id", "text")
    return found.select("item_id", F.col("source").alias("doc_id"), "start", "shown")


@query(f"""WITH {bm25_sql(k=15)}, h0 AS (SELECT *, 0 AS hop FROM bm), miss AS (SELECT query_id FROM h0 GROUP BY 1 HAVING max(score) < 60),
a2 AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(substr(text, 1, 60)), {TOK})) AS term FROM benchmark WHERE item_id IN (FROM miss)) GROUP BY ALL),
s2 AS (SELECT query_id, id, round(sum(times * idf * tf * 2.6 / (tf + 1.6 * (1 - 0.8 + 0.8 * size / mean_size))), 6) AS score FROM a2 JOIN terms USING (term) JOIN post USING (term), tot GROUP BY ALL),
h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s2) WHERE rank <= 5 AND score > 0),
al AS (SELECT query_id, id, score, 0 AS hop, rank AS o FROM h0 UNION ALL SELECT query_id, id, score, 1, 1000000 + rank FROM h1 ANTI JOIN h0 USING (query_id, id))
SELECT query_id, id, score, hop::INT AS hop, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS rank FROM al) WHERE rank <= 20""")
def multi_hop_retrieval(t: Tables) -> DataFrame:
    """One hop; the stub judge misses what begins a query whose best score is below 60."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")

    def judge(queries: DataFrame, have: DataFrame) -> DataFrame:
        weak = have.groupBy("query_id").agg(F.max("score").alias("best")).where("best < 60").select("query_id")
        return queries.join(weak, "query_id", "left_semi").withColumn("text", F.substring("text", 1, 60))

    return retrieval.multi_hop(q, bm25.index(t.documents, "doc_id", "text"), judge)


@query(f"""WITH grid(k1, b, config) AS (VALUES (1.2, 0.45, 'k1_1.2_b_0.45'), (1.2, 0.8, 'k1_1.2_b_0.80'), (1.6, 0.45, 'k1_1.6_b_0.45'), (1.6, 0.8, 'k1_1.6_b_0.80')), {INDEX},
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT config, query_id, id, round(sum(times * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean_size))), 6) AS score FROM asked JOIN terms USING (term) JOIN post USING (term), tot, grid GROUP BY ALL),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5 AND score > 0),
{GT}, hit AS (SELECT config, query_id, max(contains(x, g)::INT) AS found FROM rk JOIN dn ON dn.doc_id = rk.id JOIN gt ON gt.item_id = query_id GROUP BY ALL)
SELECT config, round(avg(found), 6) AS recall_at_5, count(*)::BIGINT AS queries, row_number() OVER (ORDER BY round(avg(found), 6) DESC, config)::INT AS place FROM hit GROUP BY config""")
def param_grid_best(t: Tables) -> DataFrame:
    """Recall of the ground truth among five hits over a grid of BM25 parameters, as one plan."""
    from pyspark.sql import Window

    grid = [(k1, b, f"k1_{k1}_b_{b:.2f}") for k1 in (1.2, 1.6) for b in (0.45, 0.8)]
    names = F.array(*(F.lit(name) for _, _, name in grid))
    rk = bm25.best(t.benchmark, bm25.index(t.documents, "doc_id", "text"), "item_id", "text", 5, tuple((k1, b) for k1, b, _ in grid))
    rk = sizes.small(saved(rk.select(F.get(names, F.col("setting")).alias("config"), "query_id", "id")))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text").join(rk, "id").join(_truths(t).select(F.col("item_id").alias("query_id"), "truth"), "query_id")
    found = F.contains(T.normal_for_matching(F.col("text")), T.normal_for_matching(F.col("truth"))).cast("int")
    per = texts.groupBy("config", "query_id").agg(F.max(found).alias("found")).groupBy("config").agg(F.round(F.avg("found"), 6).alias("recall_at_5"), F.count("*").alias("queries"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recall_at_5"), "config")))


LETTERS = "entaoirs"
#: Letters counted and brought to length 1: a plain stand-in for an embedding that SQL can say too.
COUNTS = "[" + ", ".join(f"(length(x) - length(replace(x, '{a}', '')))::DOUBLE" for a in LETTERS) + "]"
HOPS = rf"""dd AS (SELECT doc_id AS id, text, source AS summary, trim(regexp_extract(text, '^[^,\n]*'), ' ' || chr(9) || chr(13)) AS header FROM documents),
qq AS (SELECT item_id AS query_id, replace(b.text, ',', '') AS body, coalesce(header, '') AS title FROM benchmark b LEFT JOIN dd ON id = item_id * 3),
q AS (SELECT query_id, body || chr(10) || title AS text, body, title FROM qq),
w AS (SELECT id, regexp_extract_all(lower(text || ' ' || header || CASE WHEN coalesce(summary, '') <> '' THEN ' ' || summary ELSE '' END), {TOK}) AS w FROM dd),
post AS (SELECT id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT id, unnest(w) AS term, len(w) AS size FROM w) GROUP BY id, term),
tot AS (SELECT count(*) AS docs, avg(len(w)) AS mean_size FROM w), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, tot),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
dv AS (SELECT id, list_transform(v, lambda c: c / greatest(1.0, sqrt(list_sum(list_transform(v, lambda z: z * z))))) AS v FROM (SELECT id, {COUNTS} AS v FROM (SELECT id, lower(text) AS x FROM dd)))"""


def _retrieve_sql(name: str, queries: str, k: int) -> str:
    """Rows (query_id, id, score, rank) named `name` of the table `queries`."""
    n = name
    return f"""{n}q AS (SELECT query_id, list_transform(v, lambda c: c / greatest(1.0, sqrt(list_sum(list_transform(v, lambda z: z * z))))) AS v FROM (SELECT query_id, {COUNTS} AS v FROM (SELECT query_id, lower(text) AS x FROM {queries}))),
{n}v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT query_id, id, round(greatest(0.0, 1 - list_sum(list_transform(list_zip(dv.v, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) / 2), 6) AS similarity FROM {n}q q, dv)) WHERE rank <= {k}),
{n}a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), {TOK})) AS term FROM {queries}) GROUP BY ALL),
{n}s AS (SELECT query_id, id, round(sum(times * idf * tf * 2.6 / (tf + 1.6 * (1 - 0.8 + 0.8 * size / mean_size))), 6) AS score FROM {n}a JOIN terms USING (term) JOIN post USING (term), tot GROUP BY ALL),
{n}b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {n}s) WHERE rank <= {2 * k} AND score > 0),
{n}u AS (SELECT query_id, id, round(coalesce(0.5 / (60 + v.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 9) AS rrf FROM {n}v v FULL JOIN {n}b b USING (query_id, id)),
{n}f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM {n}u) WHERE rank <= {k}),
{n} AS (SELECT query_id, id, rank, round(0.45 + (rrf - min(rrf) OVER p) / CASE WHEN max(rrf) OVER p > min(rrf) OVER p THEN max(rrf) OVER p - min(rrf) OVER p ELSE 1 END * 0.55, 6) AS score FROM {n}f WINDOW p AS (PARTITION BY query_id))"""


def _letters(df: DataFrame) -> DataFrame:
    @F.arrow_udf("array<double>")
    def counts(texts: pa.Array) -> pa.Array:
        flat = pa.concat_arrays([pc.count_substring(texts, a) for a in LETTERS]).cast(pa.float64())
        by_text = flat.take(pa.array(np.arange(len(flat)).reshape(len(LETTERS), -1).T.ravel()))
        return pa.FixedSizeListArray.from_arrays(by_text, len(LETTERS)).cast(pa.list_(pa.float64()))

    n = counts(F.lower("text"))
    size = lambda v: F.greatest(F.lit(1.0), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)))
    return df.withColumn("_n", n).withColumn("vector", F.transform("_n", lambda x: x / size(F.col("_n")))).drop("_n")


def _stub_judge(queries: list[str], contexts: list[str]) -> list[str]:
    """Stands for a model: queries of a length that three divides can be answered; the others miss the title in their last line and all before it."""
    import json

    if any(not c.startswith("1. ") for c in contexts):
        raise ValueError("a context has numbered chunks")
    parts = [q.rpartition("\n") for q in queries]
    return [json.dumps({"can_answer": len(q) % 3 == 0, "reasoning": "by length", "missing_query": f"{title}, {body}"}) for q, (body, _, title) in zip(queries, parts, strict=True)]


#: The longest common subsequence of `a` and `h`, a row of its table for each character of `a`; likeness is asked only of pairs that edits allow.
LCS = """list_max(list_reduce(list_prepend(list_transform(string_split(h, ''), lambda y: 0), list_transform(string_split(a, ''), lambda x: list_transform(string_split(h, ''), lambda y: (x = y)::INT))),
lambda old, same: list_transform(range(1, len(same) + 1), lambda j: greatest(old[j], list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN same[i] = 1 THEN coalesce(old[i - 1], 0) + 1 ELSE 0 END))))))"""


@query(f"""WITH {HOPS}, {_retrieve_sql("h0", "q", 15)},
asks AS (SELECT * FROM q WHERE length(text) % 3 <> 0), hd AS (SELECT lower(trim(header)) AS h, min(id) AS id FROM dd GROUP BY 1),
tt AS (SELECT query_id, o, trim(x, '"' || chr(39)) AS title FROM (SELECT query_id, o, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM (SELECT query_id, unnest([title, body]) AS x, unnest([0, 1]) AS o FROM asks)) WHERE x <> ''),
ta AS MATERIALIZED (SELECT DISTINCT lower(trim(title)) AS a, length(lower(trim(title))) AS n, regexp_replace(lower(trim(title)), '[^\\x01-\\x7F]', '?', 'g') AS aa FROM tt WHERE trim(title) <> ''),
th AS MATERIALIZED (SELECT h, id, length(h) AS m, regexp_replace(h, '[^\\x01-\\x7F]', '?', 'g') AS hh FROM hd WHERE length(h) <= (SELECT max(n) FROM ta) * 1.36),
near AS (SELECT a, h, id FROM ta, th WHERE CASE WHEN 200 * least(n, m) >= 85 * (n + m) THEN 20 * levenshtein(aa, hh) <= 3 * (n + m) ELSE false END),
lk AS (SELECT a, id, CASE WHEN a = h THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {LCS} / (length(a) + length(h)) END AS r FROM near),
hit AS (SELECT query_id, o, arg_max(id, (r, -id)) AS id, round(max(r) / 100, 6) AS score FROM tt JOIN lk ON a = lower(trim(title)) WHERE r >= 85 GROUP BY ALL),
rest AS (SELECT query_id, string_agg(title, ', ' ORDER BY o) AS text FROM tt ANTI JOIN hit USING (query_id, o) GROUP BY 1), {_retrieve_sql("h1", "rest", 5)},
hop AS (SELECT query_id, id, round(score - 0.01, 6) AS score, o FROM hit UNION ALL SELECT query_id, id, score, 1000000 + rank FROM h1),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY o) AS n FROM hop) WHERE n = 1),
al AS (SELECT query_id, id, score, 0 AS hop, rank AS o FROM h0 UNION ALL SELECT query_id, id, score, 1, 1000000 + place FROM once ANTI JOIN h0 USING (query_id, id))
SELECT query_id, id, score::DOUBLE AS score, hop::INT AS hop, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS rank FROM al) WHERE rank <= 20""")
def hybrid_hops(t: Tables) -> DataFrame:
    """Benchmark texts, each with a header in its last line, through both lists, a judge and one hop over headers and both lists."""
    head = F.regexp_replace(F.regexp_extract("text", r"^[^,\n]*", 0), r"^[ \t\r]+|[ \t\r]+$", "")
    docs = _letters(t.documents.select(F.col("doc_id").alias("id"), head.alias("header"), "text", "source"))
    over = retrieval.corpus(docs, "id", "header", "text", "source", "vector")
    titles = docs.select((F.col("id") / 3).alias("_i"), F.col("header").alias("title"))
    both = t.benchmark.join(titles, F.col("item_id") == F.col("_i"), "left")
    queries = both.select(F.col("item_id").alias("query_id"), F.concat(F.replace("text", F.lit(","), F.lit("")), F.lit("\n"), F.coalesce("title", F.lit(""))).alias("text"))
    return retrieval.hybrid_hops(queries, over, _letters, _stub_judge)
