"""Queries of ranked lists and cross-tabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.operators import dist
from folioscope.plans.registry import corpus_query, table_query

_DIM_SQL = """
SELECT d.dst AS item_id, i.title, d.n, d.rank FROM (
  SELECT c.dst, c.n, row_number() OVER (ORDER BY c.n DESC, i.nk, c.dst) AS rank
  FROM (SELECT dst, count(DISTINCT src) AS n FROM rlinks WHERE {where} GROUP BY dst) c JOIN items i ON i.item_id = c.dst
) d JOIN items i ON i.item_id = d.dst WHERE d.rank <= {top}
"""
_WHERE = {
    "types": "term = 'dcterms:type'", "languages": "term = 'dcterms:language'", "subjects": "term = 'dcterms:subject'", "genres": "term = 'dcterms:format'",
    "contributors": "credit", "locations": "term = 'dcterms:spatial'", "current_locations": "term = 'dcterms:provenance'",
}
_NAMES = {"subjects": "subjects_top200", "contributors": "contributors_top100"}
for _dim, _where in _WHERE.items():
    corpus_query(_NAMES.get(_dim, _dim), _DIM_SQL.format(where=_where, top=dist.CAPS.get(_dim, 10**9)))(lambda c, d=_dim: dist.dimension(c, d))


@corpus_query("timeline", "SELECT year, count(*) AS n FROM rec WHERE year IS NOT NULL GROUP BY year")
def timeline(c):
    return dist.timeline(c)


HEATMAP_SQL = """
SELECT t.title AS "row", l.title AS col, CAST(count(*) AS BIGINT) AS n
FROM rlinks a JOIN rlinks b ON a.src = b.src JOIN items t ON t.item_id = a.dst JOIN items l ON l.item_id = b.dst
WHERE a.term = 'dcterms:type' AND b.term = 'dcterms:language' GROUP BY 1, 2
"""


@corpus_query("heatmap", HEATMAP_SQL)
def heatmap(c):
    return dist.heatmap(c)


@corpus_query("heatmap_by_project", """
SELECT p.dst AS entity, t.title AS "row", l.title AS col, CAST(count(*) AS BIGINT) AS n
FROM rlinks p JOIN rlinks a ON a.src = p.src JOIN rlinks b ON a.src = b.src JOIN items t ON t.item_id = a.dst JOIN items l ON l.item_id = b.dst
WHERE p.term = 'dcterms:isPartOf' AND a.term = 'dcterms:type' AND b.term = 'dcterms:language' GROUP BY 1, 2, 3
""")
def heatmap_by_project(c):
    return dist.heatmap(c, c.linking_to(C.IS_PART_OF).join(c.records, "item_id", "left_semi"))


@corpus_query("subjects_by_person", """
SELECT entity, item_id, title, n, rank FROM (
  SELECT x.entity, x.dst AS item_id, i.title, x.n, row_number() OVER (PARTITION BY x.entity ORDER BY x.n DESC, i.nk, x.dst) AS rank
  FROM (SELECT p.entity, s.dst, count(DISTINCT s.src) AS n FROM (SELECT DISTINCT dst AS entity, src FROM rlinks WHERE credit) p
        JOIN rlinks s ON s.src = p.src WHERE s.term = 'dcterms:subject' GROUP BY 1, 2) x JOIN items i ON i.item_id = x.dst
) WHERE rank <= 200
""")
def subjects_by_person(c):
    links = c.links.where(C.is_credit(F.col("term"))).join(c.records, F.col("src") == F.col("item_id"), "left_semi")
    members = links.select(F.col("dst").alias("entity"), F.col("src").alias("item_id")).distinct()
    return dist.dimension(c, "subjects", members)


_ROLE = "CASE term WHEN 'bibo:authorList' THEN 'author' WHEN 'bibo:editorList' THEN 'editor' ELSE split_part(term, ':', -1) END"


@corpus_query("roles", f"SELECT {_ROLE} AS role, count(*) AS n FROM rlinks WHERE credit GROUP BY 1")
def roles(c):
    return dist.roles(c)


@corpus_query("roles_for_entity", f"SELECT {_ROLE} AS role, count(*) AS n FROM rlinks WHERE credit AND dst = 500000003 GROUP BY 1")
def roles_for_entity(c):
    return dist.roles(c, entity=500_000_003)


@corpus_query("roles_by_entity", f"SELECT dst AS entity, {_ROLE} AS role, count(*) AS n FROM rlinks WHERE credit GROUP BY 1, 2")
def roles_by_entity(c):
    return dist.roles_by_entity(c)


@corpus_query("templates", "SELECT 'Template ' || template_id AS label, count(*) AS n FROM items WHERE template_id IS NOT NULL GROUP BY 1")
def templates(c):
    return dist.templates(c)


_VALUES_SQL = """
, linked AS (SELECT l.src, l.dst AS target, i.title AS value FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term IN ({terms})),
known AS (SELECT lower(trim(value)) AS spelt, min(target) AS known FROM linked GROUP BY 1),
vals AS (
  SELECT src, value, target FROM linked
  UNION ALL SELECT t.item_id, trim(t.value), k.known FROM literals t LEFT JOIN known k ON k.spelt = lower(trim(t.value)) WHERE t.term IN ({terms})
), keyed AS (SELECT *, CASE WHEN target IS NOT NULL THEN '#' || target ELSE lower(value) END AS key FROM vals)
"""
_AUTHOR_TERMS = "'dcterms:creator', 'dcterms:contributor', 'bibo:authorList'"


@corpus_query("top_values", _VALUES_SQL.format(terms=_AUTHOR_TERMS) + """
SELECT value, item_id, n, rank FROM (
  SELECT coalesce(i.title, g.spelling) AS value, g.item_id, g.n,
         row_number() OVER (ORDER BY g.n DESC, coalesce(i.nk, array_to_string(list_transform(regexp_extract_all(lower(g.spelling), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 20, '0') ELSE x END), '')), g.item_id) AS rank
  FROM (SELECT key, count(DISTINCT src) AS n, min(value) AS spelling, min(target) AS item_id FROM keyed GROUP BY key) g LEFT JOIN items i ON i.item_id = g.item_id
) WHERE rank <= 100
""")
def top_values(c):
    return dist.top_values(c, [C.CREATOR, C.CONTRIBUTOR, C.AUTHORS])


@corpus_query("count_distinct_values", _VALUES_SQL.format(terms=_AUTHOR_TERMS) + "SELECT count(DISTINCT key) AS n FROM keyed")
def count_distinct_values(c):
    return dist.count_distinct_values(c, [C.CREATOR, C.CONTRIBUTOR, C.AUTHORS])


@corpus_query("top_linked", _DIM_SQL.format(where="term IN ('dcterms:creator', 'dcterms:subject')", top=100))
def top_linked(c):
    return dist.top_linked(c, [C.CREATOR, C.SUBJECT])


@corpus_query("top_linked_of_class", """
SELECT d.dst AS item_id, i.title, d.n, d.rank FROM (
  SELECT c.dst, c.n, row_number() OVER (ORDER BY c.n DESC, i.nk, c.dst) AS rank
  FROM (SELECT dst, count(DISTINCT src) AS n FROM rlinks WHERE term IN ('dcterms:creator', 'dcterms:subject') GROUP BY dst) c
  JOIN items i ON i.item_id = c.dst AND i.class_term = 'foaf:Person'
) d JOIN items i ON i.item_id = d.dst WHERE d.rank <= 100
""")
def top_linked_of_class(c):
    return dist.top_linked(c, [C.CREATOR, C.SUBJECT], classes=[C.PERSON])


@corpus_query("count_linked_of_class", "SELECT count(DISTINCT dst) AS n FROM rlinks JOIN items i ON i.item_id = dst WHERE term = 'dcterms:spatial' AND i.class_term = 'dcterms:Location'")
def count_linked_of_class(c):
    return dist.count_linked_of_class(c, [C.SPATIAL], [C.LOCATION])


@corpus_query("items_linked_to_title", "SELECT count(DISTINCT src) AS n FROM rlinks JOIN items i ON i.item_id = dst WHERE term = 'dcterms:subject' AND lower(trim(i.title)) = 'brand#12'")
def items_linked_to_title(c):
    return dist.items_linked_to_title(c, C.SUBJECT, " BRAND#12 ")


@corpus_query("top_authors", """
, named AS (
  SELECT l.src, trim(i.title) AS name, l.dst AS target FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.credit AND i.class_term = 'foaf:Person'
  UNION ALL SELECT item_id, trim(value), NULL FROM literals WHERE term = 'bibo:authorList'
), g AS (SELECT name, count(DISTINCT src) AS n, bool_or(target IS NOT NULL) AS matched, max(target) AS item_id FROM named WHERE name <> '' GROUP BY name),
k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(name), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 20, '0') ELSE x END), '') AS nk FROM g)
SELECT name, n, matched, item_id, rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, nk, name) AS rank FROM k) WHERE rank <= 100
""")
def top_authors(c):
    return dist.top_authors(c)


_CO_SQL = """
SELECT entity, item_id, title, n, rank FROM (
  SELECT g.entity, g.dst AS item_id, i.title, g.n, row_number() OVER (PARTITION BY g.entity ORDER BY g.n DESC, i.title, g.dst) AS rank
  FROM (SELECT m.entity, o.dst, count(*) AS n FROM (SELECT DISTINCT dst AS entity, src FROM rlinks WHERE {dim} AND {some}) m
        JOIN rlinks o ON o.src = m.src JOIN items oi ON oi.item_id = o.dst WHERE {odim} AND o.dst <> m.entity {cls} GROUP BY 1, 2) g
  JOIN items i ON i.item_id = g.dst
) WHERE rank <= 100
"""


@corpus_query("co_authors", _CO_SQL.format(dim="credit", some="true", odim="o.credit", cls="AND oi.class_term = 'foaf:Person'"))
def co_authors(c):
    entities = c.of_class(C.PERSON).withColumnRenamed("item_id", "entity")
    return dist.co_targets(c, entities, C.is_credit(F.col("term")), [C.PERSON])


@corpus_query("co_subjects", _CO_SQL.format(dim="term = 'dcterms:subject'", some="true", odim="o.term = 'dcterms:subject'", cls=""))
def co_subjects(c):
    entities = c.of_template(6).withColumnRenamed("item_id", "entity")
    return dist.co_targets(c, entities, F.col("term") == C.SUBJECT)


@corpus_query("category_members", """
SELECT dst AS item_id, i.title, count(DISTINCT src) AS n FROM rlinks JOIN items i ON i.item_id = dst
WHERE term IN ('dcterms:spatial', 'dcterms:provenance') AND i.class_term = 'dcterms:Location' GROUP BY 1, 2
""")
def category_members(c):
    return dist.category_members(c, [C.SPATIAL, C.PROVENANCE], c.of_class(C.LOCATION))


@corpus_query("sections_bar", """
SELECT s.title AS section, count(*) AS n FROM links l JOIN items s ON s.item_id = l.dst JOIN items p ON p.item_id = l.src
WHERE l.term = 'dcterms:isPartOf' AND s.class_term = 'frapo:ResearchGroup' AND p.class_term = 'foaf:Project' AND lower(s.title) <> 'external' GROUP BY 1
""")
def sections_bar(c):
    return dist.sections_bar(c)


@corpus_query("section_university", """
SELECT s.title AS section, f.title AS funder, CAST(sum(z.n) AS BIGINT) AS n
FROM (SELECT dst AS project, count(DISTINCT src) AS n FROM rlinks WHERE term = 'dcterms:isPartOf' GROUP BY 1) z
JOIN links ls ON ls.src = z.project AND ls.term = 'dcterms:isPartOf' JOIN items s ON s.item_id = ls.dst
JOIN links lf ON lf.src = z.project AND lf.term = 'frapo:isFundedBy' JOIN items f ON f.item_id = lf.dst GROUP BY 1, 2
""")
def section_university(c):
    return dist.section_university(c)


@corpus_query("stat_cards", """
SELECT key, label, value FROM (
  SELECT 'items' AS key, 'Items' AS label, count(*) AS value FROM rec
  UNION ALL SELECT 'people', 'People', count(DISTINCT dst) FROM rlinks WHERE credit
  UNION ALL SELECT 'places', 'Places', count(DISTINCT dst) FROM rlinks WHERE term = 'dcterms:spatial'
  UNION ALL SELECT 'podcasts', 'Podcasts', count(*) FROM memberships WHERE set_id = 2
  UNION ALL SELECT 'nothing', 'Nothing', count(*) FROM rlinks WHERE term = 'no:such'
) WHERE value > 0
""")
def stat_cards(c):
    links, _ = c.scoped()
    term = F.col("term")
    card = lambda df, key, label: df.agg(F.lit(key).alias("key"), F.lit(label).alias("label"), F.count(F.lit(1)).alias("value"))
    cards = [
        card(c.records, "items", "Items"),
        card(links.where(C.is_credit(term)).select("dst").distinct(), "people", "People"),
        card(links.where(term == C.SPATIAL).select("dst").distinct(), "places", "Places"),
        card(c.memberships.where("set_id = 2"), "podcasts", "Podcasts"),
        card(links.where(term == "no:such"), "nothing", "Nothing"),
    ]
    return dist.union(cards).where("value > 0 and key != '' and label != ''")


_PROFILE_SQL = """
, mem AS (SELECT DISTINCT dst AS entity, src FROM rlinks WHERE term = 'dcterms:isPartOf'),
prof AS (
  SELECT m.entity, count(DISTINCT m.src) AS items,
         count(DISTINCT CASE WHEN l.term = 'dcterms:language' THEN l.dst END) AS languages,
         count(DISTINCT CASE WHEN l.term = 'dcterms:subject' THEN l.dst END) AS subjects,
         count(DISTINCT CASE WHEN l.credit THEN l.dst END) AS contributors,
         count(DISTINCT CASE WHEN l.term = 'dcterms:type' THEN l.dst END) AS types,
         CAST(coalesce(max(i.year) - min(i.year), 0) AS BIGINT) AS year_span
  FROM mem m JOIN items i ON i.item_id = m.src LEFT JOIN links l ON l.src = m.src GROUP BY 1)
"""


def _project_members(c):
    return c.linking_to(C.IS_PART_OF).join(c.records, "item_id", "left_semi").select("entity", "item_id")


@corpus_query("profiles", _PROFILE_SQL + "SELECT * FROM prof")
def profiles(c):
    return dist.profiles(c, _project_members(c))


@corpus_query("radar", _PROFILE_SQL + ", mx AS (SELECT " + ", ".join(f"max({a}) AS m_{a}" for a in dist.AXES) + " FROM prof) " + " UNION ALL ".join(
    f"SELECT entity, '{a}' AS axis, {a} AS value, round({a} / CAST(m_{a} AS DOUBLE), 6) AS share FROM prof, mx WHERE m_{a} > 0 AND " + "(" + " + ".join(f"CAST({b} > 0 AS INT)" for b in dist.AXES) + ") >= 3"
    for a in dist.AXES
))
def radar(c):
    return dist.radar(dist.profiles(c, _project_members(c)))


@corpus_query("source_counts", """
SELECT 'items' AS source, count(*) AS n FROM items UNION ALL SELECT 'relationships', count(*) FROM links
UNION ALL SELECT 'sets', count(DISTINCT set_id) FROM memberships UNION ALL SELECT 'places', count(*) FROM geo
""")
def source_counts(c):
    return dist.source_counts(c)


@corpus_query("source_coverage", """
, f AS (SELECT m.set_id AS source, bool_or(l.term = 'dcterms:subject') AS subjects, bool_or(l.credit) AS credits, bool_or(l.term = 'frapo:isFundedBy') AS funders
  FROM memberships m JOIN links l ON l.src = m.item_id WHERE m.set_id IS NOT NULL GROUP BY 1)
SELECT CAST(source AS BIGINT) AS source, 'subjects' AS dimension, subjects AS covered FROM f UNION ALL SELECT source, 'credits', credits FROM f UNION ALL SELECT source, 'funders', funders FROM f
""")
def source_coverage(c):
    term = F.col("term")
    sources = c.memberships.withColumnRenamed("set_id", "source")
    return dist.source_coverage(c, {"subjects": term == C.SUBJECT, "credits": C.is_credit(term), "funders": term == C.FUNDER}, sources)


@corpus_query("boxplot", """
, z AS (SELECT dst AS project, count(DISTINCT src) AS n FROM rlinks WHERE term = 'dcterms:isPartOf' GROUP BY 1),
v AS (SELECT s.title AS label, z.n FROM z JOIN links l ON l.src = z.project AND l.term = 'dcterms:isPartOf' JOIN items s ON s.item_id = l.dst WHERE z.n > 0)
SELECT label, round(quantile_cont(n, 0.0), 6) AS low, round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.5), 6) AS median,
       round(quantile_cont(n, 0.75), 6) AS q3, round(quantile_cont(n, 1.0), 6) AS high
FROM v GROUP BY label HAVING (SELECT count(DISTINCT label) FROM v) >= 2
""")
def boxplot(c):
    sizes = dist.project_sizes(c).withColumnRenamed("section", "dst").join(c.titles(), "dst")
    return dist.boxplot(sizes.select(F.col("title").alias("label"), F.col("n").alias("value")))


@corpus_query("paged_bar", """
SELECT title, n, rank, CAST(floor((rank - 1) / 20) + 1 AS BIGINT) AS page FROM (
  SELECT i.title, c.n, row_number() OVER (ORDER BY c.n DESC, i.nk, c.dst) AS rank
  FROM (SELECT dst, count(DISTINCT src) AS n FROM rlinks WHERE credit GROUP BY dst) c JOIN items i ON i.item_id = c.dst)
WHERE rank <= 100
""")
def paged_bar(c):
    rows = dist.dimension(c, "contributors")
    return rows.select("title", "n", "rank", dist.page(F.col("rank")).alias("page"))


@table_query("duration_histogram", """
SELECT CAST(CASE WHEN s < 1200 THEN 0 WHEN s < 1800 THEN 1 WHEN s < 2400 THEN 2 WHEN s < 3000 THEN 3 WHEN s < 3600 THEN 4 ELSE 5 END AS INTEGER) AS band, count(*) AS n
FROM (SELECT CAST(floor(value * 20) AS BIGINT) AS s FROM events) WHERE s > 0 GROUP BY 1
""")
def duration_histogram(spark, sf_dir):
    """Durations go through their ISO spelling and back."""
    seconds = F.floor(F.col("value") * 20).cast("long")
    iso = F.format_string("PT%dH%dM%dS", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(seconds >= 0)
    return dist.duration_histogram(events.select(C.iso_seconds(iso).alias("seconds")))
