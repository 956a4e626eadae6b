"""Query op11: all pages to WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, warc


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark)
    index = warc.write(common.table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


NAME = "op11_warc"
SQL = r"""WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS latest FROM d),
v AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(s, 1 + 5 * k::INT, 5))::BIGINT) AS v FROM g)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x >> b) & 31)::INT, 1)), '')), '') AS payload_digest,
CASE WHEN latest IS NULL OR page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to FROM v"""
