"""Query over the WARC source and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import table
from folioscope.llm.warc import warc_round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


QUERIES = {"op1_warc": op1_warc}
#: 40 hexadecimal digits are 8 groups of 20 bits, each of four base-32 digits.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * CAST(k // 4 AS INTEGER), 5) AS INTEGER) >> (15 - 5 * CAST(k % 4 AS INTEGER))) & 31), 1)), '') AS payload_digest
  FROM s
), f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

SQL = {"op1_warc": OP1_SQL}
