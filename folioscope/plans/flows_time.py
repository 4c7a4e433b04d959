"""Queries of hierarchies, flows and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.operators import dist, flows, temporal
from folioscope.plans.registry import corpus_query, table_query

_NK = "array_to_string(list_transform(regexp_extract_all(lower({0}), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 20, '0') ELSE x END), '')"


def nk(column: str) -> str:
    return _NK.format(column)


@corpus_query("sunburst", f"""
, s AS (SELECT src, title AS subject FROM (SELECT l.src, i.title, row_number() OVER (PARTITION BY l.src ORDER BY l.ord) AS k FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:subject') WHERE k <= 5),
c AS (
  SELECT t.title AS type, g.title AS language, coalesce(s.subject, '(no subject)') AS subject, count(*) AS n
  FROM rlinks a JOIN items t ON t.item_id = a.dst JOIN rlinks b ON b.src = a.src JOIN items g ON g.item_id = b.dst LEFT JOIN s ON s.src = a.src
  WHERE a.term = 'dcterms:type' AND b.term = 'dcterms:language' GROUP BY 1, 2, 3)
SELECT type, language, subject, n FROM (SELECT *, row_number() OVER (PARTITION BY type, language ORDER BY n DESC, {nk('subject')}, subject) AS r FROM c) WHERE r <= 8
""")
def sunburst(c):
    return flows.sunburst(c)


@corpus_query("treemap", """
, home AS (SELECT r.item_id AS src, coalesce(p.title, '(unassigned)') AS project FROM rec r
  LEFT JOIN (SELECT l.src, arg_min(l.dst, l.ord) AS dst FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project' GROUP BY 1) f ON f.src = r.item_id
  LEFT JOIN items p ON p.item_id = f.dst)
SELECT h.project, t.title AS type, count(*) AS n, z.items FROM home h JOIN rlinks l ON l.src = h.src AND l.term = 'dcterms:type' JOIN items t ON t.item_id = l.dst
JOIN (SELECT project, count(*) AS items FROM home GROUP BY 1) z ON z.project = h.project GROUP BY 1, 2, 4
""")
def treemap(c):
    return flows.treemap(c)


@corpus_query("content_sources", f"""
, g AS (SELECT s.title AS label, count(DISTINCT l.src) AS n FROM rlinks l JOIN items s ON s.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND s.class_term = 'foaf:Project' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, {nk('label')}, label) AS k, count(*) OVER () AS groups FROM g)
SELECT CASE WHEN k > 11 AND groups > 12 THEN 'Other' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1
""")
def content_sources(c):
    first = dist.first_per(c, C.IS_PART_OF, [C.PROJECT]).withColumnRenamed("target", "dst").join(c.titles(), "dst")
    return flows.content_sources(first.select("item_id", F.col("title").alias("label")))


@corpus_query("sankey", f"""
, p AS (SELECT src, title AS person FROM (SELECT l.src, i.title, row_number() OVER (PARTITION BY l.src ORDER BY l.ord, l.term) AS k FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.credit) WHERE k <= 3),
j AS (SELECT l.src, arg_max(i.title, l.ord) AS project FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project' GROUP BY 1),
f AS (SELECT p.person, j.project, t.title AS type, count(*) AS n FROM p JOIN j ON j.src = p.src JOIN rlinks l ON l.src = p.src AND l.term = 'dcterms:type' JOIN items t ON t.item_id = l.dst GROUP BY 1, 2, 3),
best AS (SELECT person FROM (SELECT person, row_number() OVER (ORDER BY sum(n) DESC, {nk('person')}, person) AS k FROM f GROUP BY person) WHERE k <= 10),
g AS (SELECT * FROM f WHERE person IN (SELECT person FROM best))
SELECT person AS source, project AS target, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1, 2 UNION ALL SELECT project, type, CAST(sum(n) AS BIGINT) FROM g GROUP BY 1, 2
""")
def sankey(c):
    return flows.sankey(c)


@corpus_query("geo_flows", """
SELECT a.dst AS origin, b.dst AS current, count(*) AS n FROM rlinks a JOIN rlinks b ON b.src = a.src
WHERE a.term = 'dcterms:spatial' AND b.term = 'dcterms:provenance' AND a.dst <> b.dst AND a.dst IN (SELECT item_id FROM geo) AND b.dst IN (SELECT item_id FROM geo) GROUP BY 1, 2
""")
def geo_flows(c):
    return flows.geo_flows(c)


@corpus_query("stacked_timeline", """
SELECT r.year, coalesce(t.title, 'No type') AS name, count(*) AS n FROM rec r LEFT JOIN (SELECT l.src, i.title FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:type') t ON t.src = r.item_id
WHERE r.year IS NOT NULL GROUP BY 1, 2
""")
def stacked_timeline(c):
    return temporal.stacked_timeline(c)


@corpus_query("subject_trends", f"""
, y AS (SELECT r.year, i.title AS name, count(*) AS n FROM rec r JOIN rlinks l ON l.src = r.item_id JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:subject' GROUP BY 1, 2),
best AS (SELECT name FROM (SELECT name, row_number() OVER (ORDER BY sum(n) DESC, {nk('name')}, name) AS k FROM y GROUP BY name) WHERE k <= 10),
z AS (SELECT * FROM y WHERE name IN (SELECT name FROM best))
SELECT yy.year, nn.name, coalesce(z.n, 0) AS n FROM (SELECT DISTINCT year FROM z) yy CROSS JOIN (SELECT DISTINCT name FROM z) nn LEFT JOIN z ON z.year = yy.year AND z.name = nn.name
""")
def subject_trends(c):
    return temporal.subject_trends(c)


@corpus_query("language_timeline", """
SELECT r.year, i.title AS name, count(*) AS n FROM rec r JOIN rlinks l ON l.src = r.item_id JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:language' GROUP BY 1, 2
""")
def language_timeline(c):
    return temporal.language_timeline(c)


@corpus_query("beeswarm", """
SELECT i.item_id, i.title, CAST(regexp_extract(t.start, '(\\d{4})', 1) AS INTEGER) AS start_year, CAST(greatest(coalesce(z.n, 0), 1) AS BIGINT) AS size
FROM items i JOIN temporal t ON t.item_id = i.item_id LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM links WHERE term = 'dcterms:isPartOf' GROUP BY 1) z ON z.dst = i.item_id
""")
def beeswarm(c):
    return temporal.beeswarm(c)


@corpus_query("gantt", """
SELECT i.item_id, i.title, t.start, t."end", row_number() OVER (ORDER BY t.start, i.nk, i.item_id) AS rank FROM items i JOIN temporal t ON t.item_id = i.item_id
""")
def gantt(c):
    return temporal.gantt(c)


_CHORD = """
, r AS (SELECT DISTINCT {key} AS k, l.src, l.dst FROM rlinks l JOIN rec ON rec.item_id = l.src WHERE l.term = 'dcterms:subject'),
s AS (SELECT r.* FROM r JOIN (SELECT k, src FROM r GROUP BY 1, 2 HAVING count(*) >= 2) m ON m.k = r.k AND m.src = r.src),
nodes AS (SELECT k, dst, n, rank FROM (SELECT k, dst, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, lpad(CAST(dst AS VARCHAR), 20, '0')) AS rank FROM s GROUP BY 1, 2) WHERE rank <= {top}),
t AS (SELECT s.* FROM s JOIN nodes n ON n.k = s.k AND n.dst = s.dst),
edges AS (SELECT a.k, a.dst AS a, b.dst AS b, count(*) AS n FROM t a JOIN t b ON a.k = b.k AND a.src = b.src AND a.dst < b.dst GROUP BY 1, 2, 3 HAVING count(*) >= 2)
"""


@corpus_query("time_chord", _CHORD.format(key="rec.year", top=16) + "SELECT k AS year, a, b, n FROM edges WHERE (SELECT count(DISTINCT k) FROM edges) >= 2")
def time_chord(c):
    return temporal.time_chord(c)


_NEW = """
, newest AS (SELECT max(created) AS d FROM items),
w AS (SELECT m AS months, CAST(date_trunc('month', d) - to_months(CAST(m AS INTEGER)) AS DATE) + CAST(day(d) - 1 AS INTEGER) AS cutoff FROM newest, (VALUES (3), (6), (12)) v(m)),
fresh AS (SELECT CAST(w.months AS INTEGER) AS months, i.item_id, i.title, i.nk, i.created FROM items i JOIN w ON i.created >= w.cutoff)
"""


@corpus_query("whats_new_counts", _NEW + "SELECT months, count(*) AS n FROM fresh GROUP BY 1")
def whats_new_counts(c):
    return temporal.whats_new_counts(c)


@corpus_query("whats_new_items", _NEW + "SELECT months, item_id, title, created, rank FROM (SELECT *, row_number() OVER (PARTITION BY months ORDER BY created DESC, item_id) AS rank FROM fresh) WHERE rank <= 24")
def whats_new_items(c):
    return temporal.whats_new_items(c)


@corpus_query("whats_new_projects", _NEW + """
SELECT months, item_id, title, n, rank FROM (
  SELECT g.months, g.p AS item_id, i.title, g.n, row_number() OVER (PARTITION BY g.months ORDER BY g.n DESC, g.p) AS rank
  FROM (SELECT f.months, x.p, count(*) AS n FROM fresh f JOIN (SELECT l.src, min(l.dst) AS p FROM links l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project' GROUP BY 1) x ON x.src = f.item_id GROUP BY 1, 2) g
  JOIN items i ON i.item_id = g.p) WHERE rank <= 10
""")
def whats_new_projects(c):
    return temporal.whats_new_projects(c)


@corpus_query("sibling_sparkline", """
, kids AS (SELECT l.dst AS p, l.src, l.ord FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project'),
line AS (SELECT k.p, r.year, count(*) AS n FROM kids k JOIN rec r ON r.item_id = k.src WHERE r.year IS NOT NULL GROUP BY 1, 2),
f AS (SELECT k.src, arg_min(k.p, k.ord) AS p FROM kids k WHERE k.p IN (SELECT p FROM line GROUP BY 1 HAVING count(*) > 1) GROUP BY 1)
SELECT f.src AS item_id, f.p AS project, line.year, line.n, coalesce(line.year = r.year, false) AS here FROM f JOIN line ON line.p = f.p JOIN rec r ON r.item_id = f.src
""")
def sibling_sparkline(c):
    return temporal.sibling_sparkline(c)


@corpus_query("decade_groups", """
, d AS (SELECT CAST(floor(r.year / 10) * 10 AS INTEGER) AS decade, CASE WHEN p.title LIKE '%A%' THEN p.title END AS label, count(*) AS n
  FROM rec r JOIN (SELECT src, arg_min(dst, ord) AS dst FROM rlinks WHERE term = 'dcterms:isPartOf' GROUP BY 1) l ON l.src = r.item_id JOIN items p ON p.item_id = l.dst GROUP BY 1, 2)
SELECT decade, label, n, share FROM (SELECT decade, label, n, round(n / sum(n) OVER (PARTITION BY decade), 6) AS share FROM d) WHERE label IS NOT NULL
""")
def decade_groups(c):
    project = dist.first_per(c, C.IS_PART_OF).withColumnRenamed("target", "dst").join(c.titles(), "dst")
    rows = c.items.join(project.select("item_id", F.col("title").alias("name")), "item_id")
    return temporal.decade_groups(rows.select("year", F.when(F.col("name").contains("A"), F.col("name")).alias("label")))


@corpus_query("rate_smoothed", """
, h AS (SELECT i.title AS word, r.year, count(*) AS n FROM rec r JOIN rlinks l ON l.src = r.item_id JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:language' AND r.year % 2 = 0 GROUP BY 1, 2),
t AS (SELECT year, count(*) AS total FROM rec GROUP BY 1),
g AS (SELECT w.word, t.year, t.total, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT word FROM h) w CROSS JOIN t LEFT JOIN h ON h.word = w.word AND h.year = t.year)
SELECT word, year, round(n / CAST(total AS DOUBLE) * 10000, 6) AS rate,
       round(sum(n) OVER w / CAST(sum(total) OVER w AS DOUBLE) * 10000, 6) AS smooth
FROM g WINDOW w AS (PARTITION BY word ORDER BY year RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)
""")
def rate_smoothed(c):
    hits, _ = temporal.by_year(c, C.LANGUAGE)
    totals = dist.timeline(c).withColumnRenamed("n", "total")
    return temporal.smoothed_rates(hits.where("year % 2 = 0").withColumnRenamed("name", "word"), totals)


@table_query("tumbling_counts", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def tumbling_counts(spark, sf_dir):
    from folioscope.streaming import windows

    return windows.daily(spark.read.parquet(f"{sf_dir}/events.parquet"))


@table_query("sliding_counts", """
SELECT CAST(d AS DATE) AS start_day, event_type, count(*) AS n FROM (
  SELECT e.event_type, CAST(date_trunc('day', ts) AS DATE) - CAST(k AS INTEGER) AS d FROM events e, range(7) r(k)) GROUP BY 1, 2
""")
def sliding_counts(spark, sf_dir):
    from folioscope.streaming import windows

    return windows.weekly_sliding(spark.read.parquet(f"{sf_dir}/events.parquet"))


@table_query("sessions", """
, e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, k
""".replace(", e AS", "WITH e AS", 1))
def sessions(spark, sf_dir):
    from folioscope.streaming import windows

    return windows.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
