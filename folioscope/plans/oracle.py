"""The corpus of folioscope.sources.bridge as DuckDB CTEs, for the oracle SQL of its queries."""

CORPUS = r"""
WITH subj AS (SELECT name, 600000000 + dense_rank() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT p_brand AS name FROM part)),
typ AS (SELECT name, 700000000 + dense_rank() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT p_type AS name FROM part)),
lang AS (SELECT name, 800000000 + dense_rank() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)),
genre AS (SELECT name, 900000000 + dense_rank() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT o_orderpriority AS name FROM orders)),
ords AS (
  SELECT 1000000000 + o_orderkey AS src, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, c_nationkey, o_custkey, lang.id AS language, genre.id AS genre
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lang ON lang.name = c_mktsegment JOIN genre ON genre.name = o_orderpriority
), lines AS (
  SELECT 1000000000 + l_orderkey AS src, CAST(l_linenumber AS BIGINT) AS ln, l_suppkey, s_name, s_nationkey, l_returnflag,
         o_orderstatus = 'F' AND l_linestatus = 'O' AS literal, subj.id AS subject, typ.id AS type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN subj ON subj.name = p_brand JOIN typ ON typ.name = p_type JOIN supplier ON l_suppkey = s_suppkey
), raw AS (
  SELECT src, 'dcterms:isPartOf' AS term, 200000000 + c_nationkey AS dst, 0 AS ln FROM ords
  UNION ALL SELECT src, 'dcterms:language', language, 0 FROM ords
  UNION ALL SELECT src, 'dcterms:format', genre, 0 FROM ords
  UNION ALL SELECT src, 'dcterms:spatial', 300000000 + c_nationkey, 0 FROM ords
  UNION ALL SELECT src, 'dcterms:isPartOf', 950000000 + c_nationkey, 1 FROM ords WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0
  UNION ALL SELECT src, 'marcrel:pup', 300000000 + o_custkey % 25, 0 FROM ords WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 1
  UNION ALL SELECT src, 'dcterms:subject', subject, ln FROM lines
  UNION ALL SELECT src, 'dcterms:type', type, ln FROM lines
  UNION ALL SELECT src, 'dcterms:provenance', 300000000 + s_nationkey, ln FROM lines
  UNION ALL SELECT src, CASE l_returnflag WHEN 'A' THEN 'dcterms:creator' WHEN 'N' THEN 'dcterms:contributor' WHEN 'R' THEN 'marcrel:aut' END,
                   500000000 + l_suppkey, ln FROM lines WHERE NOT literal
  UNION ALL SELECT 200000000 + n_nationkey, 'dcterms:isPartOf', 100000000 + n_regionkey, 0 FROM nation
  UNION ALL SELECT 300000000 + n_nationkey, 'dcterms:isPartOf', 350000000 + n_regionkey, 0 FROM nation
  UNION ALL SELECT 950000000 + n_nationkey, 'dcterms:spatial', 300000000 + n_nationkey, 0 FROM nation
  UNION ALL SELECT 200000000 + n_nationkey, 'frapo:isFundedBy', 400000000 + (n_nationkey + 7) % 25, 0 FROM nation
  UNION ALL SELECT 500000000 + s_suppkey, 'dcterms:isPartOf', 400000000 + s_nationkey, 0 FROM supplier
), links AS MATERIALIZED (
  SELECT CAST(src AS BIGINT) AS src, term, CAST(dst AS BIGINT) AS dst, CAST(min(ln) * 10000000000 + dst AS BIGINT) AS ord,
         term IN ('dcterms:creator', 'dcterms:contributor', 'bibo:authorList', 'bibo:editorList')
           OR (term LIKE 'marcrel:%' AND term NOT IN ('marcrel:dbp', 'marcrel:evp', 'marcrel:mfp', 'marcrel:prp', 'marcrel:pup', 'marcrel:uvp')) AS credit
  FROM raw GROUP BY src, term, dst
), items0 AS (
  SELECT 100000000 + r_regionkey AS item_id, r_name AS title, 7 AS template_id, 'frapo:ResearchGroup' AS class_term, CAST(NULL AS DATE) AS created FROM region
  UNION ALL SELECT 200000000 + n_nationkey, 'Project ' || n_name, 5, 'foaf:Project', NULL FROM nation
  UNION ALL SELECT 300000000 + n_nationkey, n_name, 3, 'dcterms:Location', NULL FROM nation
  UNION ALL SELECT 350000000 + r_regionkey, r_name, 3, 'dcterms:Location', NULL FROM region
  UNION ALL SELECT 400000000 + n_nationkey, 'Institute ' || n_name, 2, 'foaf:Organization', NULL FROM nation
  UNION ALL SELECT 950000000 + n_nationkey, 'Journal ' || n_name, 8, 'bibo:Journal', NULL FROM nation
  UNION ALL SELECT 500000000 + s_suppkey, s_name, 4, 'foaf:Person', NULL FROM supplier
  UNION ALL SELECT id, name, 6, NULL, NULL FROM subj
  UNION ALL SELECT id, name, NULL, NULL, NULL FROM typ
  UNION ALL SELECT id, name, NULL, NULL, NULL FROM lang
  UNION ALL SELECT id, name, NULL, NULL, NULL FROM genre
  UNION ALL SELECT src, 'Order ' || o_orderkey, 10, NULL, day FROM ords
), items AS MATERIALIZED (
  SELECT CAST(item_id AS BIGINT) AS item_id, title, template_id, class_term, created, CAST(year(created) AS INTEGER) AS year,
         array_to_string(list_transform(regexp_extract_all(lower(title), '\d+|\D+'),
           lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(x, 20, '0') ELSE x END), '') AS nk
  FROM items0
), rec AS (SELECT * FROM items WHERE template_id = 10),
rlinks AS (SELECT * FROM links WHERE src >= 1000000000),
literals AS (SELECT CAST(src AS BIGINT) AS item_id, 'bibo:authorList' AS term, s_name AS value, min(ln) AS ord FROM lines WHERE literal GROUP BY src, s_name),
memberships AS (SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS set_id, src AS item_id FROM ords),
geo AS (
  SELECT CAST(base + n_nationkey AS BIGINT) AS item_id, CAST((n_nationkey * 37) % 130 - 60 AS DOUBLE) AS lat, CAST((n_nationkey * 53) % 340 - 170 AS DOUBLE) AS lon
  FROM nation, (VALUES (300000000), (400000000)) b(base)
), temporal AS (
  SELECT CAST(200000000 + n_nationkey AS BIGINT) AS item_id, CAST(1990 + n_nationkey % 10 AS VARCHAR) AS start, CAST(1993 + n_nationkey % 10 AS VARCHAR) AS "end" FROM nation
)
"""
