"""Query over phrase collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import table
from folioscope.llm.phrases import collocations


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS words FROM p
), s AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), g AS (
  SELECT lang, words[i : i + m - 1] AS phrase, m FROM s, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(words)
), f AS (
  SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, m, f AS a FROM f WHERE m >= 2 AND f >= 30
), inner_parts AS (
  SELECT lang, a, phrase[i : i + q - 1] AS phrase
  FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS q)
  WHERE q < m AND i + q - 1 <= m
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase
  WHERE NOT coalesce(100 * CAST(o.longer AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT), false)
), cuts AS (
  SELECT lang, phrase, a, k, phrase[1 : k] AS first, phrase[k + 1 : m] AS rest
  FROM kept, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m
), scored AS (
  SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r,
         CAST(2000000 * CAST(u.a AS HUGEINT) // (CAST(x.f AS HUGEINT) + CAST(y.f AS HUGEINT)) AS BIGINT) AS score
  FROM cuts u JOIN f x ON u.lang = x.lang AND u.first = x.phrase JOIN f y ON u.lang = y.lang AND u.rest = y.phrase
), one AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(phrase, ' '))) AS rank
  FROM one
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
SQL = {"op11_collocations": OP11_SQL}
