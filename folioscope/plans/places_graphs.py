"""Queries of geography and of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.operators import geo, knowledge
from folioscope.plans.oracle import CORPUS
from folioscope.plans.registry import corpus_query, table_query
from folioscope.sources import bridge

_CELL = ", cell AS (SELECT item_id, 'C' || CAST(floor(lat / 10) * 10 AS INTEGER) || '_' || CAST(floor(lon / 10) * 10 AS INTEGER) AS country FROM geo)"


def _countries(c):
    return geo.country_index(c.geo, geo.square_outlines(c.geo.sparkSession))


@corpus_query("country_index", _CELL + "SELECT * FROM cell")
def country_index(c):
    return _countries(c)


@corpus_query("choropleth", _CELL + "SELECT country, count(DISTINCT src) AS n FROM rlinks JOIN cell ON item_id = dst WHERE term = 'dcterms:spatial' GROUP BY 1")
def choropleth(c):
    return geo.choropleth(c, _countries(c))


@corpus_query("linked_places", """
SELECT g.item_id, i.title, g.lat, g.lon, count(DISTINCT src) AS n FROM rlinks JOIN geo g ON g.item_id = dst JOIN items i ON i.item_id = dst WHERE term = 'dcterms:provenance' GROUP BY 1, 2, 3, 4
""")
def linked_places(c):
    return geo.linked_places(c, C.PROVENANCE)


_CHAIN = """
, up AS (SELECT l.src AS place, arg_min(l.dst, l.ord) AS parent FROM links l JOIN items a ON a.item_id = l.src JOIN items b ON b.item_id = l.dst
  WHERE l.term = 'dcterms:isPartOf' AND a.class_term = 'dcterms:Location' AND b.class_term = 'dcterms:Location' GROUP BY 1),
chain AS (SELECT item_id, item_id AS place, 0 AS level FROM items WHERE class_term = 'dcterms:Location' UNION ALL SELECT place, parent, 1 FROM up)
"""


@corpus_query("place_chain", _CHAIN + "SELECT item_id, place, level FROM chain")
def place_chain(c):
    return geo.place_chain(c)


_PUBLISHED = _CHAIN + """
, pp AS (SELECT src, dst AS place, ord FROM rlinks WHERE term = 'marcrel:pup'
  UNION ALL SELECT l.src, o.dst, l.ord FROM rlinks l JOIN items j ON j.item_id = l.dst AND j.class_term = 'bibo:Journal' JOIN links o ON o.src = l.dst AND o.term = 'dcterms:spatial' WHERE l.term = 'dcterms:isPartOf'),
pub AS (SELECT DISTINCT c.place AS entity, pp.src FROM pp JOIN chain c ON c.item_id = pp.place)
"""


@corpus_query("publication_places", _PUBLISHED + "SELECT src, place, ord FROM pp")
def publication_places(c):
    return geo.publication_places(c)


@corpus_query("publications_by_place", _PUBLISHED + "SELECT pub.entity AS item_id, i.title, count(*) AS n FROM pub JOIN items i ON i.item_id = pub.entity GROUP BY 1, 2")
def publications_by_place(c):
    return geo.publications_by_place(c)


@corpus_query("published_timeline", _PUBLISHED + """
SELECT pub.entity, r.year, coalesce(i.title, 'No type') AS name, count(*) AS n FROM pub JOIN items r ON r.item_id = pub.src LEFT JOIN links l ON l.src = pub.src AND l.term = 'dcterms:type' LEFT JOIN items i ON i.item_id = l.dst
WHERE r.year IS NOT NULL GROUP BY 1, 2, 3
""")
def published_timeline(c):
    return geo.published_timeline(c)


def _region_names(c):
    """(alias, outline): names that three of the five regions answer to; the others go by their titles."""
    rows = [("Asia and Oceania", ["ASIA", "Oceania"], 0), ("The Americas", ["America"], 1), ("Others", ["asia", "Africa"], 2)]
    return geo.outline_names(c.items.sparkSession.createDataFrame(rows, "name string, aliases array<string>, k int"))


@corpus_query("publication_countries", _PUBLISHED + """
, top AS (SELECT item_id, arg_max(place, level) AS top FROM chain GROUP BY 1),
key AS (SELECT t.item_id, CASE lower(i.title) WHEN 'asia' THEN 'Asia and Oceania' WHEN 'africa' THEN 'Others' WHEN 'america' THEN 'The Americas' END AS outline, i.title,
  coalesce(tg.lat, g.lat) AS lat, coalesce(tg.lon, g.lon) AS lon
  FROM top t JOIN items i ON i.item_id = t.top LEFT JOIN geo tg ON tg.item_id = t.top LEFT JOIN geo g ON g.item_id = t.item_id)
SELECT coalesce(outline, title) AS country, outline, count(DISTINCT pp.src) AS n, arg_min(lat, (pp.src, pp.ord)) AS lat, arg_min(lon, (pp.src, pp.ord)) AS lon
FROM pp JOIN memberships m ON m.item_id = pp.src AND m.set_id = 1 JOIN key ON key.item_id = pp.place GROUP BY 1, 2
""")
def publication_countries(c):
    return geo.publication_countries(c, c.memberships.where("set_id = 1"), _region_names(c))


@table_query("project_affiliation_map", CORPUS + """
, team AS (SELECT project, person, min(ord) AS at FROM (
  SELECT 200000000 + s_suppkey % 25 AS project, 500000000 + s_suppkey AS person, 500000000 + s_suppkey AS ord FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL SELECT 200000000 + (s_suppkey * 3) % 25, 500000000 + s_suppkey, 10000000000 + 500000000 + s_suppkey FROM supplier WHERE s_suppkey % 4 = 0) GROUP BY 1, 2),
named AS (SELECT t.project, l.dst AS institution, p.title, min((t.at, t.person)) AS at FROM team t
  JOIN (SELECT DISTINCT src, dst FROM links WHERE term = 'dcterms:isPartOf') l ON l.src = t.person JOIN items p ON p.item_id = t.person GROUP BY 1, 2, 3)
SELECT n.project, n.institution, o.title AS name, g.lat, g.lon, string_agg(n.title, ' | ' ORDER BY n.at) AS members
FROM named n JOIN items o ON o.item_id = n.institution JOIN geo g ON g.item_id = n.institution
WHERE o.class_term = 'foaf:Organization' AND n.project IN (SELECT item_id FROM items WHERE class_term = 'foaf:Project') GROUP BY 1, 2, 3, 4, 5
""")
def project_affiliation_map(spark, sf_dir):
    corpus = bridge.teams(bridge.load(spark, sf_dir), spark, sf_dir)
    return geo.project_affiliation_map(corpus).withColumn("members", F.array_join("members", " | "))


_SP = """
, sp AS (SELECT dst AS item_id, count(DISTINCT CASE WHEN term = 'dcterms:spatial' THEN src END) AS origins, count(DISTINCT CASE WHEN term = 'dcterms:provenance' THEN src END) AS currents
  FROM rlinks WHERE term IN ('dcterms:spatial', 'dcterms:provenance') GROUP BY 1)
"""


@corpus_query("spatial_places", _SP + "SELECT sp.*, g.lat, g.lon FROM sp JOIN geo g ON g.item_id = sp.item_id")
def spatial_places(c):
    return geo.spatial_places(c)


@corpus_query("spatial_countries", _SP + _CELL + """
SELECT *, row_number() OVER (ORDER BY origins + currents DESC, country) AS rank FROM (
  SELECT cell.country, count(*) AS places, CAST(sum(origins) AS BIGINT) AS origins, CAST(sum(currents) AS BIGINT) AS currents, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east
  FROM sp JOIN geo g ON g.item_id = sp.item_id JOIN cell ON cell.item_id = sp.item_id GROUP BY 1)
""")
def spatial_countries(c):
    return geo.spatial_countries(c, _countries(c))


_EP = """
, ep AS (SELECT m.dst AS entity, l.dst AS place, count(DISTINCT CASE WHEN l.term = 'dcterms:spatial' THEN l.src END) AS origins, count(DISTINCT CASE WHEN l.term = 'dcterms:provenance' THEN l.src END) AS currents
  FROM rlinks m JOIN rlinks l ON l.src = m.src WHERE m.term = 'dcterms:subject' AND l.term IN ('dcterms:spatial', 'dcterms:provenance') AND l.dst IN (SELECT item_id FROM geo) GROUP BY 1, 2)
"""


def _by_subject(c):
    return c.linking_to(C.SUBJECT)


@corpus_query("entity_places", _EP + "SELECT * FROM ep")
def entity_places(c):
    return geo.entity_places(c, _by_subject(c))


@corpus_query("entity_picker", _EP + "SELECT entity, places, row_number() OVER (ORDER BY places DESC, entity) AS rank FROM (SELECT entity, count(*) AS places FROM ep GROUP BY 1)")
def entity_picker(c):
    return geo.entity_picker(c, _by_subject(c))


@corpus_query("item_map", """
SELECT src AS item_id, dst AS place, CASE WHEN bool_or(term = 'dcterms:spatial') THEN 'origin' ELSE 'current' END AS role
FROM rlinks WHERE term IN ('dcterms:spatial', 'dcterms:provenance') AND dst IN (SELECT item_id FROM geo) GROUP BY 1, 2
""")
def item_map(c):
    return geo.item_map(c)


@corpus_query("color_breaks", """
, t AS (SELECT max(n) AS top FROM (SELECT count(DISTINCT src) AS n FROM rlinks WHERE term = 'dcterms:spatial' GROUP BY dst)),
b AS (SELECT k AS step, CAST(round(exp(ln(top + 1) * k / 4) - 1) AS BIGINT) AS value FROM t, range(5) r(k))
SELECT CAST(step AS INTEGER) AS step, value FROM b
""")
def color_breaks(c):
    return geo.color_breaks(geo.linked_places(c, C.SPATIAL))


_STATS = """
, st AS (SELECT dst AS resource, count(DISTINCT src) AS df, round(ln((SELECT count(*) FROM items) / count(DISTINCT src)), 2) AS idf,
  round(100 * count(DISTINCT src) / (SELECT count(*) FROM items), 1) AS freq_pct FROM links GROUP BY 1)
"""
_SHARE = "(term IN ('dcterms:subject', 'dcterms:isPartOf', 'dcterms:spatial', 'dcterms:creator', 'dcterms:contributor', 'bibo:authorList', 'bibo:editorList') OR term LIKE 'marcrel:%')"


@corpus_query("resource_idf", _STATS + "SELECT * FROM st")
def resource_idf(c):
    return knowledge.resource_stats(c)


@corpus_query("postings_sampled", f"""
, o AS (SELECT DISTINCT dst AS resource, src FROM links WHERE {_SHARE}),
p AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY src) - 1 AS p, count(*) OVER (PARTITION BY resource) AS n FROM o)
SELECT resource, src FROM p WHERE n <= 256 OR p IN (SELECT CAST(floor(i * p.n / 256) AS BIGINT) FROM range(256) r(i))
""")
def postings_sampled(c):
    return knowledge.postings(c)


_SHARED = _STATS + f"""
, o AS (SELECT DISTINCT dst AS resource, src FROM rlinks WHERE {_SHARE}),
sh AS (SELECT a.src AS center, b.src AS item_id, round(sum(st.idf), 2) AS strength, count(*) AS shared FROM o a JOIN o b ON b.resource = a.resource AND b.src <> a.src JOIN st ON st.resource = a.resource GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY strength DESC, item_id) AS rank FROM sh)
"""


@corpus_query("kg_shared_items", _SHARED + "SELECT * FROM rk WHERE rank <= 90")
def kg_shared_items(c):
    return knowledge.shared_items(c)


_CAT = """CASE WHEN l.term = 'dcterms:isPartOf' THEN CASE WHEN t.class_term = 'bibo:Journal' THEN 'Publication venue' ELSE 'Project' END
  WHEN l.term IN ('dcterms:creator', 'dcterms:contributor') THEN 'Person' WHEN l.term = 'dcterms:subject' THEN 'Subject' WHEN l.term IN ('dcterms:spatial', 'dcterms:provenance', 'marcrel:pup') THEN 'Location'
  WHEN l.term = 'dcterms:format' THEN 'Genre' WHEN l.term LIKE 'marcrel:%' THEN 'Contributor' END"""
_DIRECT = f"""
, dr AS (SELECT l.src AS center, l.dst AS item_id, l.term, {_CAT} AS category FROM rlinks l JOIN items t ON t.item_id = l.dst),
dk AS (SELECT *, dense_rank() OVER (PARTITION BY center ORDER BY list_position(['Person', 'Contributor', 'Subject', 'Project', 'Publication venue', 'Location', 'Institution', 'Genre', 'Related item'], category), item_id) AS rank FROM dr WHERE category IS NOT NULL)
"""


@corpus_query("kg_direct", _DIRECT + "SELECT * FROM dk WHERE rank <= 220")
def kg_direct(c):
    return knowledge.direct_relations(c)


@corpus_query("kg_reverse", """
SELECT center, item_id, category, rank FROM (
  SELECT l.dst AS center, l.src AS item_id, CASE WHEN i.class_term = 'frapo:ResearchGroup' THEN 'Project' ELSE 'Linked Item' END AS category, row_number() OVER (PARTITION BY l.dst ORDER BY l.src) AS rank
  FROM links l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf') WHERE rank <= 40
""")
def kg_reverse(c):
    return knowledge.reverse_relations(c)


@corpus_query("kg_fallback", """
, poor AS (SELECT i.item_id FROM items i LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM links GROUP BY 1) o ON o.src = i.item_id WHERE coalesce(o.n, 0) < 5)
SELECT center, item_id, rank FROM (SELECT dst AS center, src AS item_id, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank FROM (SELECT DISTINCT dst, src FROM links WHERE dst IN (SELECT item_id FROM poor))) WHERE rank <= 60
""")
def kg_fallback(c):
    return knowledge.fallback_relations(c)


_GRAPH = _SHARED + _DIRECT + f"""
, rv AS (SELECT center, item_id, category, rank FROM (
  SELECT l.dst AS center, l.src AS item_id, CASE WHEN i.class_term = 'frapo:ResearchGroup' THEN 'Project' ELSE 'Linked Item' END AS category, row_number() OVER (PARTITION BY l.dst ORDER BY l.src) AS rank
  FROM links l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf') WHERE rank <= 40),
poor AS (SELECT i.item_id FROM items i LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM links GROUP BY 1) o ON o.src = i.item_id WHERE coalesce(o.n, 0) < 5),
fb AS (SELECT center, item_id, rank FROM (SELECT dst AS center, src AS item_id, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank FROM (SELECT DISTINCT dst, src FROM links WHERE dst IN (SELECT item_id FROM poor))) WHERE rank <= 60),
found AS (
  SELECT center, item_id, 0 AS stage, rank, category, NULL AS strength, NULL AS shared FROM dk WHERE rank <= 220 UNION ALL SELECT center, item_id, 1, rank, category, NULL, NULL FROM rv
  UNION ALL SELECT center, item_id, 2, rank, 'Research Item', NULL, NULL FROM fb UNION ALL SELECT center, item_id, 3, rank, 'Shared Item', strength, shared FROM rk WHERE rank <= 90),
once AS (SELECT center, item_id, min((stage, rank, category)) AS f, max(strength) AS strength, max(shared) AS shared FROM found WHERE item_id <> center GROUP BY 1, 2),
nd AS MATERIALIZED (SELECT center, item_id, f[3] AS category, strength, shared, row_number() OVER (PARTITION BY center ORDER BY f[1], f[2], item_id) AS seq FROM once),
lb AS (SELECT src, dst, arg_min(term, (ord, term)) AS term FROM links WHERE {_SHARE} GROUP BY 1, 2),
mine AS (SELECT DISTINCT center, item_id AS resource FROM dk WHERE rank <= 220 AND {_SHARE}),
ties AS MATERIALIZED (SELECT rk.center, rk.item_id, lb.dst AS resource, lb.term, st.freq_pct FROM rk JOIN lb ON lb.src = rk.item_id JOIN mine ON mine.center = rk.center AND mine.resource = lb.dst JOIN st ON st.resource = lb.dst WHERE rk.rank <= 90),
drawn AS (SELECT DISTINCT center, least(item_id, resource) AS a, greatest(item_id, resource) AS b FROM ties),
one AS (SELECT a.center, least(l.src, l.dst) AS a, greatest(l.src, l.dst) AS b, min((a.seq, l.ord, l.term, l.src, l.dst)) AS e
  FROM nd a JOIN links l ON l.src = a.item_id JOIN nd b ON b.center = a.center AND b.item_id = l.dst WHERE a.seq <= 250 AND l.src <> l.dst AND l.dst <> a.center GROUP BY 1, 2, 3),
cr AS (SELECT * FROM (SELECT one.center, e[4] AS source, e[5] AS target, e[3] AS term, row_number() OVER (PARTITION BY one.center ORDER BY e[1], e[2], e[3]) AS rank
  FROM one WHERE NOT EXISTS (SELECT 1 FROM drawn d WHERE d.center = one.center AND d.a = one.a AND d.b = one.b)) WHERE rank <= 400)
"""


@corpus_query("kg_nodes", _GRAPH + "SELECT center, item_id, category, CAST(strength AS DOUBLE) AS strength, shared, seq FROM nd")
def kg_nodes(c):
    return knowledge.assembled(c).nodes


@corpus_query("kg_cross_edges", _GRAPH + "SELECT center, source, target, term, rank FROM cr")
def kg_cross_edges(c):
    return knowledge.assembled(c).cross


@corpus_query("kg_graphs", _GRAPH + """
, ed AS (
  SELECT center, 'direct' AS kind, NULL AS freq_pct FROM dk WHERE rank <= 220 AND item_id <> center UNION ALL SELECT center, 'reverse', NULL FROM rv WHERE item_id <> center
  UNION ALL SELECT center, 'reference', NULL FROM fb WHERE item_id <> center AND NOT EXISTS (SELECT 1 FROM dk WHERE dk.center = fb.center AND dk.item_id = fb.item_id AND dk.rank <= 220) AND NOT EXISTS (SELECT 1 FROM rv WHERE rv.center = fb.center AND rv.item_id = fb.item_id)
  UNION ALL SELECT center, 'cross', NULL FROM cr UNION ALL SELECT center, 'shared', freq_pct FROM ties)
SELECT n.center, n.nodes, coalesce(e.edges, 0) AS edges, CAST(coalesce(e.cross_edges, 0) AS BIGINT) AS cross_edges, n.max_strength, e.max_freq_pct
FROM (SELECT center, count(*) AS nodes, max(strength) AS max_strength FROM nd GROUP BY 1) n
LEFT JOIN (SELECT center, count(*) AS edges, count(*) FILTER (kind = 'cross') AS cross_edges, max(freq_pct) AS max_freq_pct FROM ed GROUP BY 1) e ON e.center = n.center
""")
def kg_graphs(c):
    return knowledge.assembled(c).stats()


@corpus_query("kg_slider", _STATS + f"""
, o AS (SELECT DISTINCT dst AS resource, src FROM rlinks WHERE {_SHARE}),
sl AS (SELECT a.src AS center, b.src AS item_id, round(sum(st.idf), 2) AS strength FROM o a JOIN o b ON b.resource = a.resource AND b.src <> a.src JOIN st ON st.resource = a.resource WHERE st.freq_pct <= 3.8 GROUP BY 1, 2)
SELECT center, item_id, strength, rank FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY strength DESC, item_id) AS rank FROM sl WHERE strength >= 6.0) WHERE rank <= 30
""")
def kg_slider(c):
    return knowledge.shared_items(c, top=30, max_freq_pct=3.8, min_strength=6.0).select("center", "item_id", "strength", "rank")


@corpus_query("kg_stats", _SHARED + _DIRECT + """
, nd AS (SELECT center, item_id FROM dk WHERE rank <= 220 UNION SELECT center, item_id FROM rk WHERE rank <= 90)
SELECT nd.center, count(*) AS nodes, max(m.best) AS max_strength FROM nd LEFT JOIN (SELECT center, max(strength) AS best FROM rk GROUP BY 1) m ON m.center = nd.center GROUP BY 1
""")
def kg_stats(c):
    lists = knowledge.shared_lists(c).select("center", "items", (F.element_at("cents", 1) / 100).alias("max_strength"))
    return knowledge.list_stats(knowledge.direct_relations(c), lists)


@corpus_query("kg_first_labels", f"SELECT src, dst, arg_min(term, (ord, term)) AS term FROM links WHERE {_SHARE} GROUP BY 1, 2")
def kg_first_labels(c):
    return knowledge.first_labels(c)


@corpus_query("kg_edge_stats", _SHARED + _DIRECT + f"""
, lb AS (SELECT src, dst, arg_min(term, (ord, term)) AS term FROM links WHERE {_SHARE} GROUP BY 1, 2),
mine AS (SELECT DISTINCT center, item_id AS resource FROM dk WHERE rank <= 220 AND {_SHARE})
SELECT rk.center, count(*) AS edges, max(st.freq_pct) AS max_freq_pct FROM rk JOIN lb ON lb.src = rk.item_id JOIN mine ON mine.center = rk.center AND mine.resource = lb.dst JOIN st ON st.resource = lb.dst WHERE rk.rank <= 90 GROUP BY 1
""")
def kg_edge_stats(c):
    return knowledge.edge_stats(knowledge.shared_edges(c, knowledge.direct_relations(c), knowledge.shared_items(c)))


@corpus_query("kg_communities")
def kg_communities(c):
    return knowledge.assembled(c).communities()
