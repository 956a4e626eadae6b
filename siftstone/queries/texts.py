"""Queries over text functions and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, cleaning
from .base import Tables, query

NORMAL = "replace(replace(replace(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '*', ''), '[...]', ''), '…', ''), '...', '')"


@query(f"SELECT doc_id, md5({NORMAL}) AS digest, length({NORMAL})::BIGINT AS n FROM documents")
def normalize_for_matching(t: Tables) -> DataFrame:
    x = T.normal_for_matching(F.col("text"))
    return t.documents.select("doc_id", F.md5(x).alias("digest"), F.length(x).cast("long").alias("n"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\*\*([^*]+)\*\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '_([^_]+)_', '\1', 'g'), '`([^`]+)`', '\1', 'g') AS x FROM documents)
SELECT doc_id, md5(trim(regexp_replace(lower(replace(replace(replace(x, '[...]', ''), '…', ''), '...', '')), '\s+', ' ', 'g'))) AS digest FROM a""")
def quote_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.normal_quote(F.col("text"))).alias("digest"))


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.?!])[ \t\r\f\v]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: s <> '')"


@query(f"WITH a AS (SELECT doc_id, {SENTENCES} AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, chr(30))) AS digest FROM a")
def sentence_split(t: Tables) -> DataFrame:
    s = T.sentences(F.col("text"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\x1e")).alias("digest"))


@query(f"""WITH a AS (SELECT doc_id, {SENTENCES} AS s FROM documents),
b AS (SELECT doc_id, i, s[i] AS x, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM a) WHERE i % 4 IN (1, 2)),
c AS (SELECT doc_id, island, min(i) AS first, string_agg(x, ' ' ORDER BY i) AS x FROM b GROUP BY ALL)
SELECT a.doc_id, md5(coalesce(string_agg(x, ' [...] ' ORDER BY first), '')) AS digest, count(x)::BIGINT AS runs FROM a LEFT JOIN c USING (doc_id) GROUP BY a.doc_id""")
def verbatim_spans(t: Tables) -> DataFrame:
    """Sentences 1, 2, 5, 6, 9, ... of each text, as an answer would quote them."""
    df = t.documents.select("doc_id", T.sentences(F.col("text")).alias("s"))
    wanted = F.filter(F.sequence(F.lit(0), F.size("s") + 3), lambda i: (i % 4).isin(1, 2))
    df = df.withColumn("x", T.verbatim(F.col("s"), wanted))
    return df.select("doc_id", F.md5("x").alias("digest"), ((F.size("s") + 3) / 4).cast("long").alias("runs"))


@query(f"WITH a AS (SELECT doc_id, {SENTENCES} AS s FROM documents) SELECT doc_id, md5(array_to_string(list_transform(s, lambda x, i: '[S' || i || '] ' || x), chr(10))) AS digest FROM a")
def sentence_numbering(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.array_join(T.numbered(T.sentences(F.col("text"))), "\n")).alias("digest"))


@query(r"""SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM
(SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?') AS w FROM documents)""")
def tokenize_stats(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", T.tokens(F.col("text")).alias("w"))
    return df.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("digest"))


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(f"""WITH a AS (SELECT doc_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode('doc/' || doc_id || '.md')) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1)::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS document_id FROM a""")
def uuid5_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.uuid5(NAMESPACE, F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("document_id"))


@query("""SELECT doc_id, sha256(text) AS content_hash, sha256(source || ':' || doc_id) AS user_hash, source || ':' || doc_id AS context_key,
sha256(lower(trim(text)) || ':' || source) AS cache_key, right(md5(text), 8) AS display_id FROM documents""")
def content_hashes(t: Tables) -> DataFrame:
    key = F.concat_ws(":", "source", "doc_id")
    return t.documents.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.sha2(key, 256).alias("user_hash"), key.alias("context_key"), F.sha2(F.concat_ws(":", F.lower(F.trim("text")), "source"), 256).alias("cache_key"), F.right(F.md5("text"), F.lit(8)).alias("display_id"))


@query("""WITH a AS (SELECT doc_id, source || '/' || substr(text, 1, 90) AS raw FROM documents), b AS (SELECT doc_id, raw, regexp_replace(raw, '[^a-zA-Z0-9_-]', '_', 'g') AS safe FROM a)
SELECT doc_id, CASE WHEN safe = raw AND length(safe) <= 64 THEN safe ELSE substr(safe, 1, 55) || '_' || substr(sha1(raw), 1, 8) END AS custom_id FROM b""")
def custom_ids(t: Tables) -> DataFrame:
    raw = F.concat(F.col("source"), F.lit("/"), F.substring("text", 1, 90))
    df = t.documents.select("doc_id", raw.alias("raw")).withColumn("safe", F.regexp_replace("raw", "[^a-zA-Z0-9_-]", "_"))
    return df.select("doc_id", F.when((F.col("safe") == F.col("raw")) & (F.length("safe") <= 64), F.col("safe")).otherwise(F.concat(F.substring("safe", 1, 55), F.lit("_"), F.substring(F.sha1("raw"), 1, 8))).alias("custom_id"))


BLOCK = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
for _p in T.INJECTION:
    BLOCK = f"regexp_replace({BLOCK}, '(?i){_p}', '[BLOCKED]', 'g')"
BLOCKED = f"substr(regexp_replace({BLOCK}, '\\n{{3,}}', chr(10) || chr(10), 'g'), 1, 2000)"
ANY_INJECTION = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in T.INJECTION)


@query(f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'please IGNORE previous  instructions; onload= x ' || text ELSE text END AS text FROM conversations)
SELECT conv_id, turn, ({ANY_INJECTION}) AS injected, md5({BLOCKED}) AS digest FROM a""")
def injection_scan(t: Tables) -> DataFrame:
    x = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("please IGNORE previous  instructions; onload= x "), F.col("text"))).otherwise(F.col("text"))
    df = t.conversations.select("conv_id", "turn", x.alias("text"))
    return df.select("conv_id", "turn", T.injection_found(F.col("text")).alias("injected"), F.md5(T.blocked(F.col("text"))).alias("digest"))


def _sql_kinds() -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in T.PII.items()) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, {_sql_kinds()} AS kinds FROM documents")
def pii_scan(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(T.pii_kinds(F.col("text")), ",").alias("kinds"))


REDACT = "'user_id: ' || doc_id || ' ' || text"
for _p, _r in T.REDACTIONS:
    REDACT = f"regexp_replace({REDACT}, '{_p}', '{_r}', 'g')"


@query(f"SELECT doc_id, md5({REDACT}) AS digest FROM documents")
def pii_redact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.redacted(F.concat(F.lit("user_id: "), F.col("doc_id").cast("string"), F.lit(" "), F.col("text")))).alias("digest"))


@query(r"""SELECT doc_id, md5(trim(substr(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}]', '', 'g'), '\s+', ' ', 'g'), 1, 16000))) AS digest,
CASE WHEN f LIKE '%.md' THEN f ELSE f || '.md' END AS filename FROM (SELECT doc_id, text, regexp_replace(replace(replace(replace(substr(text, 1, 40), '..', ''), '/', ''), '\', ''), '[^a-zA-Z0-9._-]', '', 'g') AS f FROM documents)""")
def sanitize_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.for_model(F.col("text"))).alias("digest"), T.safe_filename(F.substring("text", 1, 40)).alias("filename"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(x, '(?i)!\[.*\]\(javascript:') OR regexp_matches(x, '(?i)\[.*\]\(data:') OR regexp_matches(x, '(?is)```.*?<script') THEN 'injection'
WHEN contains(x, '```python') OR contains(x, '```bash') OR contains(x, '```sh') THEN 'code' WHEN contains(lower(x), '<script') THEN 'script' END AS fault
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN '```bash' || chr(10) || url WHEN 2 THEN '[x](data:' || url ELSE url END AS x FROM pages)""")
def markdown_security(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    x = F.when(k == 0, F.col("html")).when(k == 1, F.concat(F.lit("```bash\n"), F.col("url"))).when(k == 2, F.concat(F.lit("[x](data:"), F.col("url"))).otherwise(F.col("url"))
    return t.pages.select("page_id", T.markdown_fault(x).alias("fault"))


@query(r"""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f, text FROM documents), b AS (SELECT doc_id, f, f[1:150] AS h, text FROM a),
c AS (SELECT *, CASE WHEN contains(h, '.') THEN length(h) - strpos(reverse(h), '.') + 1 ELSE 0 END AS stop FROM b)
SELECT doc_id, CASE WHEN length(f) <= 150 THEN f WHEN stop - 1 > 75 THEN h[1:stop] ELSE h || '...' END AS snippet,
array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> '')[1:3], '-') AS test_id,
CASE WHEN length(text) <= 60 THEN text ELSE text[1:57] || '...' END AS short FROM c""")
def display_texts(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", T.snippet(x).alias("snippet"), T.slug(x).alias("test_id"), T.truncated(x, 60).alias("short"))


@query("""SELECT p_partkey, split_part(m, '#', 1) AS base, CASE WHEN contains(m, '#') THEN split_part(m, '#', 2) END AS effort, replace(m, '#', '-') AS slug
FROM (SELECT p_partkey, lower(replace(p_brand, ' ', '-')) || CASE WHEN p_size % 2 = 0 THEN '#high' ELSE '' END AS m FROM part)""")
def model_names(t: Tables) -> DataFrame:
    m = F.concat(F.lower(F.replace(F.col("p_brand"), F.lit(" "), F.lit("-"))), F.when(F.col("p_size") % 2 == 0, "#high").otherwise(""))
    return t.part.select("p_partkey", T.base_model(m).alias("base"), T.effort(m).alias("effort"), F.replace(m, F.lit("#"), F.lit("-")).alias("slug"))


@query(r"""WITH a AS (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 20 - 1, 0), 80)) AS s FROM a)
SELECT doc_id, (s // 80)::BIGINT AS part, len(w[s + 1:s + 100])::BIGINT AS n, md5(array_to_string(w[s + 1:s + 100], ' ')) AS digest FROM b""")
def token_windows(t: Tables) -> DataFrame:
    """Windows of 100 words that overlap by 20."""
    words = t.documents.select("doc_id", F.split(T.squeeze(F.col("text")), " ").alias("w"))
    df = words.select("doc_id", F.posexplode(T.token_windows(F.col("w"), 100, 20)).alias("part", "x"))
    return df.select("doc_id", F.col("part").cast("long"), F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", " ")).alias("digest"))


# -- chunking: every fifth line of a document is made a header ------------------------

MARKDOWN = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 3 THEN '## ' || x ELSE x END), chr(10))"
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CHUNKS = f"""WITH md AS (SELECT doc_id, {MARKDOWN} AS md FROM documents),
ln AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM md),
hd AS (SELECT *, regexp_matches(line, '^##( |$)') AS h FROM ln),
sec AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM hd),
raw AS (SELECT doc_id, s, string_agg(line, chr(10) ORDER BY i) AS body, max(CASE WHEN h THEN trim(regexp_replace(line, '^##', ''), {TRIM}) ELSE '' END) AS header, bool_or(h) AS headed FROM sec GROUP BY doc_id, s),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS position, header, CASE WHEN headed THEN 2 ELSE 0 END AS header_level, trim(body, {TRIM}) AS text,
  len(regexp_extract_all(body, '[^ \\t\\n\\r\\f\\v]+')) AS token_count FROM raw)"""


@query(f"{CHUNKS} SELECT doc_id, position::BIGINT AS position, header, header_level::INT AS header_level, token_count::BIGINT AS token_count, md5(text) AS digest FROM chunks")
def chunk_headers(t: Tables) -> DataFrame:
    return _chunks(t).select("doc_id", F.col("position").cast("long"), "header", "header_level", F.col("token_count").cast("long"), F.md5("text").alias("digest"))


def _chunks(t: Tables) -> DataFrame:
    md = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), x)).otherwise(x)), "\n").alias("text"))
    return chunking.chunks(md, "doc_id", "text")


@query(f"{CHUNKS} SELECT doc_id, count(*)::BIGINT AS n_chunks, sum(token_count)::BIGINT AS total, round(avg(token_count), 6) AS mean, max(token_count)::BIGINT AS most, min(token_count)::BIGINT AS least FROM chunks GROUP BY doc_id")
def chunk_stats(t: Tables) -> DataFrame:
    return chunking.stats(_chunks(t), "doc_id")


@query(f"""{CHUNKS} SELECT header_level::INT AS header_level, count(*)::BIGINT AS n, round(quantile_cont(token_count, 0.25), 6) AS p25, round(quantile_cont(token_count, 0.5), 6) AS p50,
round(quantile_cont(token_count, 0.75), 6) AS p75, round(quantile_cont(token_count, 0.95), 6) AS p95 FROM chunks GROUP BY header_level""")
def chunk_size_percentiles(t: Tables) -> DataFrame:
    p = F.percentile("token_count", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.95))))
    df = _chunks(t).groupBy("header_level").agg(F.count("*").alias("n"), p.alias("p"))
    return df.select("header_level", "n", *(F.round(F.get("p", F.lit(k)), 6).alias(x) for k, x in enumerate(("p25", "p50", "p75", "p95"))))


@query(f"""{CHUNKS}, k AS (SELECT *, header || ':' || doc_id AS title FROM chunks)
SELECT doc_id, position::BIGINT AS position, sha1(encode(doc_id || '/' || position || ':' || header)) AS key, rank::BIGINT AS size_rank FROM
(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY token_count DESC, position) AS rank FROM k) WHERE rank <= 3""")
def largest_chunks(t: Tables) -> DataFrame:
    """The three largest chunks of each document."""
    df = chunking.largest(_chunks(t), "doc_id", 3)
    key = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("position").cast("string"), F.lit(":"), F.col("header"))
    return df.select("doc_id", F.col("position").cast("long"), F.sha1(key).alias("key"), F.col("size_rank").cast("long"))


@query(r"""WITH a AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN '---' || chr(10) || 'source: ' || source || chr(10) || 'last_update_date: 2024-0' || (doc_id % 9 + 1) || '-11' || chr(10) || 'document_type: core-rules' || chr(10) || '---' || chr(10) || text
 WHEN 1 THEN '---' || chr(10) || 'source: ' || source || chr(10) || 'document_type: novel' || chr(10) || '---' || chr(10) || text WHEN 2 THEN '---' || chr(10) || text ELSE text END AS md FROM documents),
b AS (SELECT doc_id, md, regexp_extract(md, '\A---\s*\n((?s:.*?))\n---\s*\n', 1) AS front, regexp_matches(md, '\A---\s*\n(?s:.*?)\n---\s*\n') AS has FROM a),
c AS (SELECT doc_id, has, regexp_extract(front, '(?m)^source: *(.*)$', 1) AS src, regexp_extract(front, '(?m)^last_update_date: *(.*)$', 1) AS day, regexp_extract(front, '(?m)^document_type: *(.*)$', 1) AS kind FROM b)
SELECT doc_id, has AS has_front, array_to_string(list_filter([CASE WHEN NOT has THEN 'frontmatter' END, CASE WHEN src = '' THEN 'source' END,
 CASE WHEN NOT regexp_matches(day, '^\d{4}-\d{2}-\d{2}$') THEN 'last_update_date' END, CASE WHEN kind NOT IN ('core-rules', 'faq', 'team-rules', 'ops') THEN 'document_type' END], lambda x: x IS NOT NULL), ',') AS faults FROM c""")
def frontmatter_validation(t: Tables) -> DataFrame:
    k, s, x = F.col("doc_id") % 5, F.col("source"), F.col("text")
    full = F.concat(F.lit("---\nsource: "), s, F.lit("\nlast_update_date: 2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-11\ndocument_type: core-rules\n---\n"), x)
    odd = F.concat(F.lit("---\nsource: "), s, F.lit("\ndocument_type: novel\n---\n"), x)
    md = t.documents.select("doc_id", F.when(k == 0, full).when(k == 1, odd).when(k == 2, F.concat(F.lit("---\n"), x)).otherwise(x).alias("md"))
    return chunking.validated(md, "md").select("doc_id", "has_front", F.array_join("faults", ",").alias("faults"))


CLEAN = r"replace(text, '’', '''')"
CLEAN_SQL = r"""WITH a AS (SELECT doc_id, replace(replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE i % 4 WHEN 0 THEN '  • ' || x WHEN 1 THEN x || '  ' WHEN 2 THEN '| a |OCP| Ranged | - |' ELSE x || ' within 6" **within**' END), chr(10)), '´', '’'), chr(13), '') AS md FROM documents),
ln AS (SELECT doc_id, unnest(string_split(replace(md, '’', ''''), chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM a),
b AS (SELECT doc_id, i, line, CASE WHEN NOT regexp_matches(trim(line), '^(-{3,}|\*\*\*)$') AND NOT starts_with(trim(line), '|') AND regexp_matches(line, '^\s*([•○◦▪▸►‣⁃↘]\s*|[*-]\s+\S)')
 THEN repeat('    ', CASE WHEN n <= 1 THEN 0 ELSE ((n + 2) // 4)::INT END) || '- ' || regexp_replace(regexp_extract(line, '^\s*(?:[•○◦▪▸►‣⁃↘]\s*|[*-]\s+)(.*)$', 1), '$^', '') ELSE line END AS bul
 FROM (SELECT *, length(regexp_extract(line, '^\s*')) AS n FROM ln)),
c AS (SELECT doc_id, i, line, bul, regexp_replace(bul, '\s+$', '') AS x FROM b)
SELECT doc_id, sum((bul <> line)::INT)::BIGINT AS bullets, sum(len(regexp_extract_all(line, '\bOCP\b')))::BIGINT AS ocr, sum(len(regexp_extract_all(line, '\*\*within\*\*')))::BIGINT AS unbolded, sum((regexp_replace(bul, '\s+$', '') <> bul)::INT)::BIGINT AS trailing FROM c GROUP BY doc_id"""


@query(CLEAN_SQL)
def clean_counts(t: Tables) -> DataFrame:
    """Changes of four of the cleaning steps over texts made into markdown."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 3, F.concat(F.lit("  • "), x)).when(i % 4 == 0, F.concat(x, F.lit("  "))).when(i % 4 == 1, F.lit("| a |OCP| Ranged | - |")).otherwise(F.concat(x, F.lit(' within 6" **within**'))))
    md = F.replace(F.replace(F.array_join(lines, "\n"), F.lit("´"), F.lit("’")), F.lit("\r"), F.lit(""))
    return cleaning.counts(t.documents.select("doc_id", md.alias("md")), "doc_id", "md").select("doc_id", "bullets", "ocr", "unbolded", "trailing")
