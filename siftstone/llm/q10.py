"""Query op10: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, html_text


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(common.table(spark, sf_dir, "pages"))


NAME = "op10_html_text"
#: The pages of the given tables all hold one article element of headings, paragraphs and inline marks.
SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h1)>'), lambda t: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS l FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(l, lambda t: t <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c"""
