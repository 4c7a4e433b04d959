"""Queries over the deduplication operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import table
from folioscope.llm.exact_dedup import exact_dedup
from folioscope.llm.line_dedup import line_dedup
from folioscope.llm.simhash import simhash_components


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (SELECT doc_id, n_chars, norm, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM k
WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), j AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

QUERIES = {"op4_simhash": op4_simhash, "op6_exact_dedup": op6_exact_dedup, "op10_line_dedup": op10_line_dedup}
SQL = {"op6_exact_dedup": OP6_SQL, "op10_line_dedup": OP10_SQL}
