"""Whole artifacts as rows (artifact, chart, a, b, c, n, rank, value), each from one reading of the statements."""

from __future__ import annotations

import re

from folioscope.operators import composites, geo
from folioscope.plans import distributions, flows_time, networks, places_graphs  # noqa: F401  (their SQL is composed below)
from folioscope.plans.oracle import CORPUS
from folioscope.plans.registry import SQL, corpus_query

#: Chart -> the single chart's query, and which of its columns are a, b, c, n, rank.
_SHAPES = {
    **{d: (q, {"a": "title", "b": "item_id", "n": "n", "rank": "rank"}) for d, q in {
        "types": "types", "languages": "languages", "subjects": "subjects_top200", "genres": "genres", "contributors": "contributors_top100",
        "locations": "locations", "current_locations": "current_locations"}.items()},
    "timeline": ("timeline", {"a": "year", "n": "n"}),
    "heatmap": ("heatmap", {"a": '"row"', "b": "col", "n": "n"}),
    "roles": ("roles", {"a": "role", "n": "n"}),
    "stacked_timeline": ("stacked_timeline", {"a": "year", "b": "name", "n": "n"}),
    "subject_trends": ("subject_trends", {"a": "year", "b": "name", "n": "n"}),
    "language_timeline": ("language_timeline", {"a": "year", "b": "name", "n": "n"}),
    "chord": ("chord_links", {"a": "a", "b": "b", "n": "n"}),
    "time_chord": ("time_chord", {"a": "a", "b": "b", "c": "year", "n": "n"}),
    "sankey": ("sankey", {"a": "source", "b": "target", "n": "n"}),
    "sunburst": ("sunburst", {"a": "type", "b": "language", "c": "subject", "n": "n"}),
    "geo_flows": ("geo_flows", {"a": "origin", "b": "current", "n": "n"}),
    "choropleth": ("choropleth", {"a": "country", "n": "n"}),
    "content_sources": ("content_sources", {"a": "label", "n": "n"}),
    "sections_bar": ("sections_bar", {"a": "section", "n": "n"}),
    "section_university": ("section_university", {"a": "section", "b": "funder", "n": "n"}),
}


def _nested(query: str) -> str:
    """The query's own CTEs below those of the corpus."""
    own = SQL[query].removeprefix(CORPUS).strip()
    return "WITH " + own[1:] if own.startswith(",") else own


def _selected(artifact: str, chart: str, source: str, columns: dict[str, str]) -> str:
    kinds = {"a": "VARCHAR", "b": "VARCHAR", "c": "VARCHAR", "n": "BIGINT", "rank": "BIGINT", "value": "DOUBLE"}
    return f"SELECT '{artifact}' AS artifact, '{chart}' AS chart, " + ", ".join(f"CAST({columns.get(k, 'NULL')} AS {t}) AS {k}" for k, t in kinds.items()) + f" FROM {source}"


def composed(artifact: str, shapes: dict[str, tuple[str, dict[str, str]]], extra: dict[str, str] | None = None) -> str:
    ctes = "".join(f", ch_{chart} AS ({_nested(query)})\n" for chart, (query, _) in shapes.items())
    rows = [_selected(artifact, chart, f"ch_{chart}", columns) for chart, (_, columns) in shapes.items()]
    return ctes + " UNION ALL ".join(rows + list((extra or {}).values()))


def _countries(c):
    return geo.country_index(c.geo, geo.square_outlines(c.geo.sparkSession))


_BOX = ["low", "q1", "median", "q3", "high"]
_OVERVIEW = composed("collection-overview", _SHAPES, {
    q: _selected("collection-overview", "boxplot", f"({_nested('boxplot')})", {"a": "label", "b": f"'{q}'", "value": q}) for q in _BOX
})


@corpus_query("overview_dashboard", _OVERVIEW)
def overview_dashboard(c):
    return composites.artifact("collection-overview", composites.dashboard(c, _countries(c)))


def _within(sql: str) -> str:
    """A query on all records, asked of publications."""
    return re.sub(r"\brec\b", "prec", re.sub(r"\brlinks\b", "plinks", sql))


_PUBLISHED = ", prec AS (SELECT r.* FROM rec r JOIN memberships m ON m.item_id = r.item_id AND m.set_id = 1), plinks AS (SELECT l.* FROM rlinks l JOIN prec ON prec.item_id = l.src)\n"
_VENUES = """(SELECT i.title, c.dst AS item_id, c.n, row_number() OVER (ORDER BY c.n DESC, i.nk, c.dst) AS rank
  FROM (SELECT l.dst, count(DISTINCT l.src) AS n FROM plinks l JOIN items t ON t.item_id = l.dst WHERE {where} GROUP BY 1) c JOIN items i ON i.item_id = c.dst)"""
_TOP = {"a": "title", "b": "item_id", "n": "n", "rank": "rank"}
_PART = ("timeline", "types", "languages", "subjects", "contributors", "genres", "stacked_timeline", "chord")
_MORE = {
    "top_journals": ("l.term = 'dcterms:isPartOf' AND t.class_term = 'bibo:Journal'", " WHERE rank <= 100"), "top_series": ("l.term = 'dcterms:isPartOf' AND t.class_term = 'bibo:Series'", " WHERE rank <= 100"),
    "funders": ("l.term = 'frapo:isFundedBy'", " WHERE rank <= 100"), "publishers": ("l.term = 'dcterms:publisher'", " WHERE rank <= 100"), "locations": ("l.term = 'marcrel:pup' AND l.dst IN (SELECT item_id FROM geo)", ""),
}
_STATS = {
    "publications": "(SELECT count(*) AS n FROM prec)", "countries": "(SELECT count(*) AS n FROM ch_publication_countries)", "types": "(SELECT count(DISTINCT dst) AS n FROM plinks WHERE term = 'dcterms:type')",
    "languages": "(SELECT count(DISTINCT dst) AS n FROM plinks WHERE term = 'dcterms:language')", "people": "(SELECT count(DISTINCT dst) AS n FROM plinks WHERE term IN ('bibo:authorList', 'bibo:editorList'))",
    "published_at": "(SELECT count(DISTINCT dst) AS n FROM plinks WHERE term = 'marcrel:pup')", "journals": "(SELECT count(DISTINCT l.dst) AS n FROM plinks l JOIN items t ON t.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND t.class_term = 'bibo:Journal')",
}
_P = "publications"


def _publications_sql() -> str:
    ctes = "".join(f", ch_{c} AS ({_within(_nested(_SHAPES[c][0]))})\n" for c in _PART) + f", ch_publication_countries AS ({_nested('publication_countries')})\n"
    parts = [_selected(_P, c, f"ch_{c}", _SHAPES[c][1]) for c in _PART]
    parts += [_selected(_P, c, _VENUES.format(where=where), _TOP) + more for c, (where, more) in _MORE.items()]
    parts += [_selected(_P, "publication_countries", "ch_publication_countries", {"a": "country", "b": "outline", "n": "n"})]
    parts += [_selected(_P, "stats", source, {"a": f"'{key}'", "n": "n"}) + " WHERE n > 0" for key, source in _STATS.items()]
    return _PUBLISHED + ctes + " UNION ALL ".join(parts)


@corpus_query("publications_dashboard", _publications_sql())
def publications_dashboard(c):
    charts = composites.publications(c, _countries(c), c.memberships.where("set_id = 1"), places_graphs._region_names(c))
    return composites.artifact(_P, charts)


_S = "spatial-exploration"
_SPATIAL = """
, pl AS (SELECT DISTINCT src, dst AS place, CASE term WHEN 'dcterms:spatial' THEN 'origin' ELSE 'current' END AS role FROM rlinks WHERE term IN ('dcterms:spatial', 'dcterms:provenance') AND dst IN (SELECT item_id FROM geo)),
en AS (
  SELECT l.src, 'Project' AS type, l.dst AS entity FROM rlinks l JOIN items t ON t.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND t.class_term = 'foaf:Project'
  UNION SELECT l.src, 'Section', u.dst FROM rlinks l JOIN items t ON t.item_id = l.dst JOIN links u ON u.src = l.dst AND u.term = 'dcterms:isPartOf' JOIN items g ON g.item_id = u.dst
    WHERE l.term = 'dcterms:isPartOf' AND t.class_term = 'foaf:Project' AND g.class_term = 'frapo:ResearchGroup'
  UNION SELECT l.src, 'Person', l.dst FROM rlinks l JOIN items t ON t.item_id = l.dst WHERE l.credit AND t.class_term = 'foaf:Person'
  UNION SELECT l.src, 'Organisation', l.dst FROM rlinks l JOIN items t ON t.item_id = l.dst WHERE t.class_term = 'foaf:Organization' AND (l.term IN ('frapo:isFundedBy', 'dcterms:provenance', 'dcterms:publisher', 'bibo:authorList', 'bibo:editorList') OR l.term LIKE 'marcrel:%')
  UNION SELECT l.src, 'Subject', l.dst FROM rlinks l WHERE l.term = 'dcterms:subject'),
ep AS (SELECT en.type, en.entity, pl.place, pl.role, count(*) AS n FROM en JOIN pl ON pl.src = en.src GROUP BY ALL),
pk AS (SELECT e.type, e.entity, i.title, e.n, row_number() OVER (PARTITION BY e.type ORDER BY e.n DESC, i.title, e.entity) AS rank
  FROM (SELECT type, entity, count(DISTINCT place) AS n FROM ep GROUP BY 1, 2) e JOIN items i ON i.item_id = e.entity),
ok AS (SELECT * FROM pk WHERE type IN ('Project', 'Section') OR rank <= 400)
"""


def _spatial_sql() -> str:
    parts = [
        _selected(_S, "locations", "(SELECT place, role, count(*) AS n FROM pl GROUP BY 1, 2)", {"a": "place", "b": "role", "n": "n"}),
        _selected(_S, "countries", "(SELECT country, role, count(*) AS n FROM pl JOIN cell ON cell.item_id = pl.place GROUP BY 1, 2)", {"a": "country", "b": "role", "n": "n"}),
        _selected(_S, "pickers", "ok", {"a": "type", "b": "entity", "c": "title", "n": "n", "rank": "rank"}),
        _selected(_S, "entity_places", "(SELECT ep.* FROM ep JOIN ok ON ok.type = ep.type AND ok.entity = ep.entity)", {"a": "entity", "b": "place", "c": "type || ' ' || role", "n": "n"}),
    ]
    return places_graphs._CELL + _SPATIAL + " UNION ALL ".join(parts)


@corpus_query("spatial_dashboard", _spatial_sql())
def spatial_dashboard(c):
    return composites.artifact(_S, composites.spatial(c, _countries(c)))
