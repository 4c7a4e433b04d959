"""Queries of co-occurrence networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.operators import network, shown
from folioscope.plans.flows_time import _CHORD
from folioscope.plans.registry import corpus_query


@corpus_query("chord_nodes", _CHORD.format(key="0", top=20) + "SELECT dst AS item_id, n, rank FROM nodes")
def chord_nodes(c):
    return network.chord_nodes(c, C.SUBJECT)[0].withColumnRenamed("dst", "item_id")


@corpus_query("chord_links", _CHORD.format(key="0", top=20) + "SELECT a, b, n FROM edges")
def chord_links(c):
    return network.chord(c, C.SUBJECT)


_PEOPLE = ", ppl AS (SELECT l.src, l.dst, l.term FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.credit AND i.class_term = 'foaf:Person')"
_AFF = ", aff AS (SELECT l.src AS person, l.dst AS inst FROM links l JOIN items a ON a.item_id = l.src JOIN items b ON b.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND a.class_term = 'foaf:Person' AND b.class_term = 'foaf:Organization')"


@corpus_query("person_project_links", _PEOPLE + """
, j AS (SELECT l.src, arg_max(l.dst, l.ord) AS project FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project' GROUP BY 1),
e AS (SELECT p.dst AS person, j.project, count(*) AS n FROM (SELECT DISTINCT src, dst FROM ppl) p JOIN j ON j.src = p.src GROUP BY 1, 2),
bp AS (SELECT person FROM (SELECT person, row_number() OVER (ORDER BY sum(n) DESC, lpad(CAST(person AS VARCHAR), 20, '0')) AS k FROM e GROUP BY 1) WHERE k <= 120),
bj AS (SELECT project FROM (SELECT project, row_number() OVER (ORDER BY sum(n) DESC, lpad(CAST(project AS VARCHAR), 20, '0')) AS k FROM e GROUP BY 1) WHERE k <= 80)
SELECT person, project, n FROM e WHERE person IN (SELECT person FROM bp) AND project IN (SELECT project FROM bj)
""")
def person_project_links(c):
    return network.person_project(c)


@corpus_query("collaboration_links", _PEOPLE + """
, d AS (SELECT DISTINCT src, dst FROM ppl) SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM d a JOIN d b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2 HAVING count(*) >= 2
""")
def collaboration_links(c):
    return network.collaboration(c)


@corpus_query("network_summary", _PEOPLE + """
, d AS (SELECT DISTINCT src, dst FROM ppl), e AS (SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM d a JOIN d b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e)) AS nodes, count(*) AS links, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM e
""")
def network_summary(c):
    return network.summary(network.collaboration(c))


@corpus_query("affiliation_links", _AFF + "SELECT person, inst AS institution, count(*) AS n FROM aff GROUP BY 1, 2 ORDER BY lpad(CAST(person AS VARCHAR), 20, '0') LIMIT 120")
def affiliation_links(c):
    return network.affiliation_network(c)


_INST = _PEOPLE + _AFF + """
, j AS (SELECT l.src, arg_max(l.dst, l.ord) AS project FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project' GROUP BY 1),
inst AS (
  SELECT l.src, l.dst FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE i.class_term = 'foaf:Organization' AND (l.credit OR l.term IN ('frapo:isFundedBy', 'dcterms:provenance'))
  UNION SELECT p.src, a.inst FROM ppl p JOIN aff a ON a.person = p.dst
  UNION SELECT j.src, l.dst FROM j JOIN links l ON l.src = j.project AND l.term = 'frapo:isFundedBy')
"""


@corpus_query("institution_pairs", _INST + "SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM inst a JOIN inst b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2")
def institution_pairs(c):
    return network.institution_collaboration(c)


@corpus_query("affiliation_ego", _AFF + """
SELECT DISTINCT inst AS entity, person, inst AS institution FROM aff
UNION SELECT DISTINCT m.inst, m.person, o.inst FROM aff m JOIN aff o ON o.person = m.person WHERE o.inst <> m.inst
""")
def affiliation_ego(c):
    return network.affiliation_ego(c)


_EGO = _INST + """
, sp AS (SELECT entity, other, n, rank FROM (
  SELECT m.dst AS entity, o.dst AS other, count(*) AS n, row_number() OVER (PARTITION BY m.dst ORDER BY count(*) DESC, o.dst) AS rank
  FROM inst m JOIN inst o ON o.src = m.src WHERE o.dst <> m.dst GROUP BY 1, 2) WHERE rank <= 25),
sh AS (SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM inst a JOIN inst b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2 HAVING count(*) >= 2)
"""


def _ego(c):
    orgs = c.of_class(C.ORGANISATION).withColumnRenamed("item_id", "entity")
    return network.ego_collaboration(c, network.institution_rows(c), orgs)


@corpus_query("collab_ego", _EGO + "SELECT entity, other, n, rank FROM sp")
def collab_ego(c):
    return _ego(c)[0]


@corpus_query("collab_ego_extra", _EGO + "SELECT x.entity, sh.a, sh.b, sh.n FROM sh JOIN sp x ON x.other = sh.a JOIN sp y ON y.entity = x.entity AND y.other = sh.b")
def collab_ego_extra(c):
    return _ego(c)[1]


@corpus_query("person_affiliation_class", _AFF + """
SELECT i.item_id, CASE WHEN bool_or(a.inst % 5 = 0) THEN 'cluster' ELSE 'partner' END AS kind FROM items i LEFT JOIN aff a ON a.person = i.item_id WHERE i.class_term = 'foaf:Person' GROUP BY 1
""")
def person_affiliation_class(c):
    return network.person_class(c, c.of_class(C.ORGANISATION).where("item_id % 5 = 0"))


@corpus_query("coauthor_pairs", """
, nm AS (
  SELECT l.src, trim(i.title) AS name, l.term = 'bibo:editorList' AS editor FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.credit AND i.class_term = 'foaf:Person'
  UNION ALL SELECT item_id, trim(value), term = 'bibo:editorList' FROM literals),
m AS (SELECT src, name, bool_or(NOT editor) AS author, bool_or(editor) AS editor FROM nm WHERE name <> '' GROUP BY 1, 2),
k AS (SELECT a.name AS a, b.name AS b, CASE WHEN a.author AND b.author THEN 'coauthor' WHEN a.editor AND b.editor THEN 'coeditor' ELSE 'mixed' END AS rel FROM m a JOIN m b ON a.src = b.src AND a.name < b.name),
g AS (SELECT a, b, count(*) AS n, count(*) FILTER (rel = 'coauthor') AS coauthor, count(*) FILTER (rel = 'coeditor') AS coeditor, count(*) FILTER (rel = 'mixed') AS mixed FROM k GROUP BY 1, 2)
SELECT *, CASE WHEN coauthor >= coeditor AND coauthor >= mixed THEN 'coauthor' WHEN coeditor >= mixed THEN 'coeditor' ELSE 'mixed' END AS relation FROM g
""")
def coauthor_pairs(c):
    return network.coauthor_pairs(c)


_ENT = _PEOPLE + _AFF + """
, ty AS (
  SELECT src, dst, 0 AS type FROM ppl UNION ALL SELECT p.src, a.inst, 1 FROM ppl p JOIN aff a ON a.person = p.dst
  UNION ALL SELECT l.src, l.dst, 2 FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term IN ('dcterms:spatial', 'dcterms:provenance') AND i.class_term = 'dcterms:Location'
  UNION ALL SELECT src, dst, 3 FROM rlinks WHERE term = 'dcterms:subject'),
ent AS (SELECT DISTINCT t.src, t.dst, m.type FROM ty t JOIN (SELECT dst, min(type) AS type FROM ty GROUP BY 1) m ON m.dst = t.dst),
ed AS (SELECT a.dst AS a, b.dst AS b, count(*) AS n FROM ent a JOIN ent b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2 HAVING count(*) >= 2)
"""


@corpus_query("entity_pairs", _ENT + "SELECT a, b, n FROM ed")
def entity_pairs(c):
    return network.entity_edges(c)


@corpus_query("entity_hub_rank", _ENT + """
, dg AS (SELECT x, count(*) AS degree FROM (SELECT a AS x FROM ed UNION ALL SELECT b FROM ed) GROUP BY 1),
h AS (SELECT e.dst AS item_id, e.type, count(*) AS items, d.degree, d.degree * 3 + count(*) AS score FROM ent e JOIN dg d ON d.x = e.dst GROUP BY 1, 2, 4)
SELECT item_id, type, items, degree, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM h
""")
def entity_hub_rank(c):
    return network.entity_hubs(c, cap=None)


@corpus_query("cluster_partners", """
SELECT f.src AS item_id, f.dst AS category, g.lat, g.lon FROM (SELECT src, arg_min(dst, ord) AS dst FROM links WHERE term = 'dcterms:isPartOf' GROUP BY 1) f
JOIN items i ON i.item_id = f.dst AND i.class_term = 'dcterms:Location' JOIN geo g ON g.item_id = f.src
""")
def cluster_partners(c):
    return network.cluster_partners(c, c.of_class(C.LOCATION))


_CI = _PEOPLE + _AFF + ", pi AS (SELECT DISTINCT p.src, p.dst AS person, a.inst FROM ppl p JOIN aff a ON a.person = p.dst JOIN geo g ON g.item_id = a.inst)"


@corpus_query("coauthor_institutions", _CI + """
SELECT institution, people, publications, row_number() OVER (ORDER BY people DESC, publications DESC, institution) AS rank
FROM (SELECT inst AS institution, count(DISTINCT person) AS people, count(DISTINCT src) AS publications FROM pi GROUP BY 1)
""")
def coauthor_institutions(c):
    return network.coauthor_institutions(c)[0]


@corpus_query("coauthor_institution_links", _CI + """
SELECT a, b, count(*) AS n FROM (SELECT DISTINCT x.src, x.inst AS a, y.inst AS b FROM pi x JOIN pi y ON x.src = y.src WHERE x.inst < y.inst AND x.person <> y.person) GROUP BY 1, 2
""")
def coauthor_institution_links(c):
    return network.coauthor_institutions(c)[1]


@corpus_query("collaboration_network")
def collaboration_network(c):
    return shown.collaboration_network(c).nodes


@corpus_query("coauthor_network")
def coauthor_network(c):
    return shown.coauthor_network(c, classes=network.person_class(c, c.of_class(C.PROJECT))).nodes


@corpus_query("coauthor_network_links")
def coauthor_network_links(c):
    return shown.coauthor_network(c).links


def _sections(c):
    """(item_id, section): the first section of the first project of each record."""
    part = c.links.where(F.col("term") == C.IS_PART_OF).select("src", "dst", "ord")
    project = network.of_class(c, part, C.PROJECT).groupBy("src").agg(F.min_by("dst", "ord").alias("project"))
    section = network.of_class(c, part, C.GROUP).groupBy(F.col("src").alias("project")).agg(F.min_by("dst", "ord").alias("section"))
    return project.join(section, "project").select(F.col("src").alias("item_id"), "section")


@corpus_query("entity_sections", _ENT + """
, part AS (SELECT l.src, l.dst, l.ord, i.class_term FROM links l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf'),
sec AS (SELECT p.src, s.dst AS section FROM (SELECT src, arg_min(dst, ord) AS dst FROM part WHERE class_term = 'foaf:Project' GROUP BY 1) p
  JOIN (SELECT src, arg_min(dst, ord) AS dst FROM part WHERE class_term = 'frapo:ResearchGroup' GROUP BY 1) s ON s.src = p.dst),
cn AS (SELECT e.dst, sec.section, count(*) AS n FROM ent e JOIN sec ON sec.src = e.src GROUP BY 1, 2),
best AS (SELECT dst, arg_min(section, (-n, section)) AS section, max(n) AS n, sum(n) AS total FROM cn GROUP BY 1)
SELECT DISTINCT e.dst AS node, CAST(CASE WHEN b.dst IS NULL THEN -1 WHEN 2 * b.n > b.total THEN b.section ELSE -2 END AS BIGINT) AS section FROM ent e LEFT JOIN best b ON b.dst = e.dst
""")
def entity_sections(c):
    return shown.dominant_sections(network.entity_rows(c).select("src", "dst"), _sections(c))


@corpus_query("entity_network")
def entity_network(c):
    return shown.entity_network(c, _sections(c)).nodes
