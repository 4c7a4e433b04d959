"""Queries of item context, narrowed views, articles and dashboards."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.operators import articles, context, dist, geo, narrow, network
from folioscope.plans import dashboards
from folioscope.plans.networks import _ENT
from folioscope.plans.places_graphs import _CELL, _EP, _SP, _by_subject, _countries
from folioscope.plans.registry import SQL, corpus_query, table_query
from folioscope.plans.texts_vectors import _KNN, _docs, _knn, _low, _transcripts, _vectors
from folioscope.streaming import windows


def _abstracts(c):
    """One literal an item, as an abstract of one kind or the other."""
    term = F.when(F.col("item_id") % 2 == 0, C.ABSTRACT).otherwise("bibo:abstract")
    rows = c.literals.groupBy("item_id").agg(F.min("value").alias("value"))
    return replace(c, literals=rows.select("item_id", term.alias("term"), "value", F.lit(1).cast("long").alias("ord")))


@corpus_query("item_contexts", """
, p AS (SELECT l.src, string_agg(l.dst || ' ' || i.title, '; ' ORDER BY l.ord) AS parents FROM links l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project' GROUP BY 1),
a AS (SELECT item_id, min(value) AS abstract FROM literals GROUP BY 1)
SELECT i.item_id, i.year, coalesce(p.parents, '') AS parents, coalesce(a.abstract, '') AS abstract FROM items i LEFT JOIN p ON p.src = i.item_id LEFT JOIN a ON a.item_id = i.item_id
""")
def item_contexts(c):
    parents = F.array_join(F.transform("parents", lambda p: F.concat_ws(" ", p["item_id"].cast("string"), p["title"])), "; ")
    return context.item_contexts(_abstracts(c)).withColumn("parents", parents)


@corpus_query("first_creator", """
SELECT l.src AS item_id, arg_min(i.title, l.ord) AS creator FROM links l JOIN items i ON i.item_id = l.dst WHERE l.term IN ('marcrel:aut', 'dcterms:creator', 'dcterms:contributor') GROUP BY 1
""")
def first_creator(c):
    return context.first_creator(c)


@corpus_query("first_literals", """
, u AS (SELECT item_id, ord, min(value) AS value FROM literals GROUP BY 1, 2)
SELECT item_id, arg_min(value, ord) FILTER (ord % 2 = 1) AS doi, arg_min(value, ord) FILTER (ord % 2 = 0) AS identifier FROM u GROUP BY 1
""")
def first_literals(c):
    rows = c.literals.groupBy("item_id", "ord").agg(F.min("value").alias("value"))
    term = F.when(F.col("ord") % 2 == 1, "bibo:doi").otherwise("dcterms:identifier")
    return context.first_literals(rows.withColumn("term", term), {"bibo:doi": "doi", "dcterms:identifier": "identifier"})


@corpus_query("projects_by_code", "SELECT right(title, 1) AS code, min(item_id) AS project FROM items WHERE class_term = 'foaf:Project' GROUP BY 1")
def projects_by_code(c):
    """The code is the last character of the title."""
    projects = c.items.where(F.col("class_term") == C.PROJECT)
    return context.projects_by_code(projects.select("item_id", F.substring("title", -1, 1).alias("code")))


@corpus_query("featured_members", """
SELECT r.item_id FROM rec r WHERE starts_with(r.title, 'Order 1') AND r.item_id IN (SELECT src FROM links WHERE term = 'marcrel:aut' AND dst = 500000001)
""")
def featured_members(c):
    named = c.items.select("item_id", F.lit("dcterms:identifier").alias("term"), F.col("title").alias("value"), F.lit(1).cast("long").alias("ord"))
    return context.featured(replace(c, literals=named), "Order 1", 500_000_001, "marcrel:aut")


@corpus_query("series_counts", """
, s AS (SELECT l.dst AS item_id, i.title, count(*) AS n FROM links l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND l.src IN (SELECT item_id FROM memberships WHERE set_id = 2) GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY n DESC, title, item_id) AS rank FROM s
""")
def series_counts(c):
    return context.series(c, c.memberships.where("set_id = 2"))


@corpus_query("playlist_counts", """
, s AS (SELECT l.dst AS item_id, i.title, count(*) AS n FROM links l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project' AND contains(i.title, '1')
  AND l.src IN (SELECT item_id FROM memberships WHERE set_id = 3) GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY n DESC, title, item_id) AS rank FROM s
""")
def playlist_counts(c):
    lists = c.items.where((F.col("class_term") == C.PROJECT) & F.col("title").contains("1"))
    return context.playlists(c, lists, c.memberships.where("set_id = 3"))


@corpus_query("subject_kinds", "SELECT DISTINCT dst AS item_id, CASE WHEN dst % 2 = 0 THEN 'heading' ELSE 'tag' END AS kind FROM links WHERE term = 'dcterms:subject'")
def subject_kinds(c):
    """Every second subject is typed as a heading."""
    typed = c.items.where("item_id between 600000000 and 699999999 and item_id % 2 = 0")
    stated = typed.select(F.col("item_id").alias("src"), F.lit(C.TYPE).alias("term"), F.lit(1).cast("long").alias("dst"), F.lit(0).cast("long").alias("ord"))
    return context.subjects_and_tags(replace(c, links=c.links.unionByName(stated.select(*c.links.columns))), F.col("dst") == 1)


@corpus_query("heatmap_synthetic_types", """
, ty AS (SELECT l.src, i.title FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:type' AND l.src NOT IN (SELECT item_id FROM memberships WHERE set_id = 1)
  UNION ALL SELECT item_id, 'Publication' FROM memberships WHERE set_id = 1)
SELECT ty.title AS "row", i.title AS "col", count(*) AS n FROM ty JOIN rlinks l ON l.src = ty.src AND l.term = 'dcterms:language' JOIN items i ON i.item_id = l.dst GROUP BY 1, 2
""")
def heatmap_synthetic_types(c):
    """Publications count as one type, whatever types they have."""
    made = c.memberships.where("set_id = 1").select("item_id", F.lit("Publication").alias("title"))
    return dist.heatmap(context.with_types(c, made))


@corpus_query("map_view", _EP + _CELL + """
SELECT ep.place AS item_id, g.lat, g.lon, ep.origins, ep.currents FROM ep JOIN geo g ON g.item_id = ep.place JOIN cell ON cell.item_id = ep.place WHERE ep.entity = 600000001 AND cell.country = 'C-30_-120'
""")
def map_view(c):
    """Places of one subject in one country."""
    return narrow.map_view(geo.spatial_places(c), _countries(c), 600_000_001, geo.entity_places(c, _by_subject(c)), "C-30_-120")


@corpus_query("map_view_country", _SP + _CELL + """
SELECT sp.item_id, g.lat, g.lon, sp.origins, sp.currents FROM sp JOIN geo g ON g.item_id = sp.item_id JOIN cell ON cell.item_id = sp.item_id WHERE cell.country = 'C-30_-120'
""")
def map_view_country(c):
    return narrow.map_view(geo.spatial_places(c), _countries(c), country="C-30_-120")


@corpus_query("facet_edges", _ENT + """
, nd AS (SELECT DISTINCT dst, type, dst % 3 AS community FROM ent)
SELECT ed.a, ed.b, ed.n FROM ed JOIN nd x ON x.dst = ed.a JOIN nd y ON y.dst = ed.b WHERE ed.n >= 3 AND x.type IN (0, 3) AND y.type IN (0, 3) AND x.community = 1 AND y.community = 1
""")
def facet_edges(c):
    rows = network.entity_rows(c)
    nodes = rows.select(F.col("dst").alias("item_id"), "type", (F.col("dst") % 3).alias("community")).distinct()
    return narrow.facet_edges(network.pairs(rows, [], 2), nodes, [0, 3], 1, 3)


@corpus_query("dominant_sections", _ENT + """
, sec AS (SELECT l.src, i.title AS section FROM rlinks l JOIN links u ON u.src = l.dst AND u.term = 'dcterms:isPartOf' JOIN items i ON i.item_id = u.dst WHERE l.term = 'dcterms:isPartOf'),
ta AS (SELECT e.dst, s.section, count(*) AS n FROM ent e JOIN sec s ON s.src = e.src GROUP BY 1, 2),
ix AS (SELECT section, row_number() OVER (ORDER BY sum(n) DESC, section) - 1 AS k FROM ta GROUP BY 1),
pe AS (SELECT dst, sum(n) AS total, max(n) AS top, arg_max(section, n) AS section FROM ta GROUP BY 1)
SELECT pe.dst AS item_id, CAST(CASE WHEN pe.top * 2 > pe.total THEN ix.k ELSE -2 END AS BIGINT) AS section FROM pe JOIN ix ON ix.section = pe.section
""")
def dominant_sections(c):
    up = c.links.where(F.col("term") == C.IS_PART_OF)
    records, _ = c.scoped()
    first = records.where(F.col("term") == C.IS_PART_OF).select("src", F.col("dst").alias("project"))
    above = up.select(F.col("src").alias("project"), "dst").join(c.titles(), "dst").select("project", F.col("title").alias("section"))
    return narrow.dominant_sections(network.entity_rows(c), first.join(above, "project").select("src", "section"))


@table_query("shown_words", f"""
WITH cloud AS ({SQL["word_cloud"]})
SELECT word, n, rank FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM cloud WHERE length(word) <> 5) WHERE rank <= 80
""")
def shown_words(spark, sf_dir):
    """Words of five letters stand for generic ones here."""
    from folioscope.operators import text

    cloud = text.word_cloud(_transcripts(spark, sf_dir))
    return narrow.shown_words(cloud, cloud.where("char_length(word) = 5"))


@table_query("semantic_groups", """
SELECT e.vec_id AS item_id, CASE WHEN l.doc_id IS NOT NULL THEN 'low signal' ELSE coalesce(CAST(e.label AS VARCHAR), '') END AS "group", l.doc_id IS NOT NULL AS low_signal
FROM embeddings e LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = e.vec_id
""")
def semantic_groups(spark, sf_dir):
    low = _low(spark, sf_dir).distinct().withColumn("low_signal", F.lit(True))
    points = _vectors(spark, sf_dir).select("item_id", "label").join(low, "item_id", "left").fillna({"low_signal": False})
    return narrow.map_groups(points, "label")


@table_query("group_labels", """
SELECT CAST(label AS BIGINT) AS id, count(*) AS size, CASE WHEN label % 2 = 0 THEN 'Group ' || label END AS label FROM embeddings WHERE label IS NOT NULL GROUP BY embeddings.label
""")
def group_labels(spark, sf_dir):
    """Labels of odd groups were given when the group was one smaller."""
    groups = _vectors(spark, sf_dir).where("label is not null").groupBy(F.col("label").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    labels = groups.select("id", (F.col("size") - F.col("id") % 2).alias("size"), F.concat(F.lit("  Group "), F.col("id").cast("string"), F.lit(" ")).alias("label"))
    return narrow.labelled(groups, labels)


def _seventeen(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 17).alias("community"), F.col("o_totalprice").alias("score"))


@table_query("folded_communities", """
WITH s AS (SELECT o_custkey % 17 AS c, row_number() OVER (ORDER BY count(*) DESC, o_custkey % 17) - 1 AS k FROM orders GROUP BY 1)
SELECT o_orderkey AS node, least(s.k, 11) AS community, s.k >= 11 AS merged FROM orders JOIN s ON s.c = o_custkey % 17
""")
def folded_communities(spark, sf_dir):
    return narrow.folded(_seventeen(spark, sf_dir))


@table_query("community_summary", """
WITH s AS (SELECT o_custkey % 17 AS community, count(*) AS size, (list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[1] AS anchor FROM orders GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY size DESC, community) AS rank FROM s
""")
def community_summary(spark, sf_dir):
    return narrow.community_summary(_seventeen(spark, sf_dir))


@table_query("corpus_counts", """
WITH d AS (SELECT doc_id, coalesce(source, '') AS corpus, bool_or(lang = 'en') AS pub, bool_or(n_chars < 100) AS low, bool_or(n_chars > 5000) AS cut FROM documents GROUP BY 1, 2)
SELECT corpus, count(*) AS fetched, count(*) FILTER (pub) AS public, count(*) FILTER (low) AS low_signal, count(*) FILTER (cut) AS truncated FROM d GROUP BY 1
""")
def corpus_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.col("n_chars")
    return articles.one_corpus_counts(docs.select(F.col("doc_id").alias("item_id"), F.coalesce("source", F.lit("")).alias("corpus"), (F.col("lang") == "en").alias("is_public"), (size < 100).alias("low_signal"), (size > 5000).alias("truncated")))


_UNIT = """
WITH r AS (SELECT vec_id AS item_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT item_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM r),
u AS (SELECT item_id, label, v, s, list_transform(v, lambda x: x / s) AS q FROM n)
"""
_EXCLUDED = _UNIT + """
, h AS (SELECT doc_id AS item_id, sha256(coalesce(text, '')) AS h FROM documents),
sh AS (SELECT item_id FROM h WHERE h IN (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1)
  UNION SELECT a.item_id FROM u a JOIN u b ON a.item_id <> b.item_id WHERE round(list_dot_product(a.q, b.q), 6) >= 0.99),
ex AS (SELECT d.doc_id AS item_id, sh.item_id IS NOT NULL AS shared, regexp_matches('Document ' || d.doc_id, '0$') AS furniture,
  len(regexp_extract_all(coalesce(d.text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) < 300 AS short, coalesce(d.lang, '') <> 'en' AS private FROM documents d LEFT JOIN sh ON sh.item_id = d.doc_id)
"""


def _articles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("item_id"), title.alias("title"), "text", (F.col("lang") == "en").alias("is_public"))


def _excluded(spark, sf_dir, min_words):
    return articles.exclusions(_articles(spark, sf_dir), _vectors(spark, sf_dir), "0$", min_words)


@table_query("article_exclusions", _EXCLUDED + "SELECT item_id, shared, furniture, short, private FROM ex")
def article_exclusions(spark, sf_dir):
    return _excluded(spark, sf_dir, 300)


@table_query("article_neighbours", _EXCLUDED.replace("< 300", "< 20") + """
, k AS (SELECT u.* FROM u JOIN ex ON ex.item_id = u.item_id WHERE NOT (shared OR furniture OR short OR private)),
p AS (SELECT a.item_id AS src, b.item_id AS dst, round(list_dot_product(a.q, b.q), 6) AS score FROM k a JOIN k b ON a.item_id <> b.item_id)
SELECT src, dst, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p WHERE score > 0) WHERE rank <= 8
""")
def article_neighbours(spark, sf_dir):
    return articles.public_map(_excluded(spark, sf_dir, 20), _vectors(spark, sf_dir))[1]


@table_query("article_points")
def article_points(spark, sf_dir):
    return articles.public_map(_excluded(spark, sf_dir, 20), _vectors(spark, sf_dir))[0]


@table_query("content_map_neighbours", _KNN + """
, pb AS (SELECT e.vec_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en')
SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY rank) AS rank FROM knn WHERE src IN (SELECT vec_id FROM pb) AND dst IN (SELECT vec_id FROM pb) AND (SELECT count(*) FROM pb) >= 20
""")
def content_map_neighbours(spark, sf_dir):
    public = _articles(spark, sf_dir).where("is_public")
    points = _vectors(spark, sf_dir).select("item_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return articles.content_map(points, _knn(spark, sf_dir), public)[1]


@table_query("corpus_layouts")
def corpus_layouts(spark, sf_dir):
    return articles.corpus_layouts(_vectors(spark, sf_dir), "label")


@table_query("passage_reasons", _UNIT + """
, t AS (SELECT u.label, u.item_id, list_distinct(list_filter(string_split(coalesce(d.text, ''), ' '), lambda w: length(w) > 3)) AS t FROM u LEFT JOIN documents d ON d.doc_id = u.item_id),
w AS (SELECT label, item_id, unnest(t) AS term FROM t), df AS (SELECT term, count(*) AS df FROM w GROUP BY 1),
nr AS (SELECT DISTINCT label AS src, (label + 1) % 10 AS dst FROM u WHERE label IS NOT NULL),
p AS (SELECT nr.src, nr.dst, a.item_id AS x, b.item_id AS y, round(list_dot_product(a.q, b.q), 4) AS s FROM nr JOIN u a ON a.label = nr.src JOIN u b ON b.label = nr.dst),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY s DESC, x, y) AS k FROM p) WHERE k = 1),
c AS (SELECT b.src, b.dst, i.term, row_number() OVER (PARTITION BY b.src, b.dst ORDER BY df.df, i.term) AS k FROM b JOIN w i ON i.item_id = b.x JOIN w j ON j.item_id = b.y AND j.term = i.term JOIN df ON df.term = i.term)
SELECT CAST(b.src AS BIGINT) AS src, CAST(b.dst AS BIGINT) AS dst, b.s AS passage_score, b.x AS source_passage, b.y AS neighbour_passage,
  coalesce((SELECT string_agg(c.term, ' ' ORDER BY c.k) FROM c WHERE c.src = b.src AND c.dst = b.dst AND c.k <= 6), '') AS shared_terms FROM b
""")
def passage_reasons(spark, sf_dir):
    """Labels stand for articles and their vectors for passages; each label is asked about the next one."""
    rows = _vectors(spark, sf_dir).where("label is not null").withColumn("label", F.col("label").cast("long"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.char_length(w) > 3)
    passages = rows.join(_docs(spark, sf_dir), "item_id", "left").select(F.col("label").alias("item_id"), F.col("item_id").alias("passage"), "vector", words.alias("terms"))
    near = rows.select(F.col("label").alias("src"), ((F.col("label") + 1) % 10).alias("dst")).distinct()
    return articles.passage_reasons(near, passages).withColumn("shared_terms", F.array_join("shared_terms", " "))


@table_query("own_card_ranks", _UNIT + """
, cd AS (SELECT item_id, list_reverse(q) AS q FROM u), o AS (SELECT u.item_id, u.q, round(list_dot_product(u.q, cd.q), 6) AS score FROM u JOIN cd ON cd.item_id = u.item_id)
SELECT o.item_id, o.score, count(cd.item_id) + 1 AS rank FROM o LEFT JOIN cd ON cd.item_id <> o.item_id AND round(list_dot_product(o.q, cd.q), 6) > o.score GROUP BY 1, 2
""")
def own_card_ranks(spark, sf_dir):
    """Cards are the vectors read backwards."""
    rows = _vectors(spark, sf_dir)
    return articles.own_card_ranks(rows, rows.select("item_id", F.reverse("vector").alias("vector")))


@table_query("bridges", _UNIT + """
, p AS (SELECT a.item_id AS src, b.item_id AS dst, round(list_dot_product(a.q, b.q), 4) AS score FROM u a JOIN u b ON a.label < 5 AND b.label >= 5)
SELECT src, dst, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p) WHERE rank <= 3
""")
def bridges(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return articles.bridges(rows.where("label < 5"), rows.where("label >= 5"))


@table_query("settled_changes", """
WITH e AS (SELECT user_id, ts, event_type = 'click' AS wd, epoch_us(ts) AS a, epoch_us(ts) + CASE WHEN event_type = 'click' THEN 60000000 ELSE 300000000 END AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a >= before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id AS site_id, max(b) AS due_us, count(*) AS n, bool_or(wd) AS withdrawn FROM g GROUP BY user_id, g
""")
def settled_changes(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windows.settled(events.select(F.col("user_id").alias("site_id"), "ts", (F.col("event_type") == "click").alias("withdrawn")))


_ONLY = ("timeline", "languages", "types", "roles", "choropleth")


@corpus_query("project_dashboard_sizes", _CELL + """
, m AS (SELECT DISTINCT l.dst AS entity, l.src AS item_id FROM rlinks l JOIN items i ON i.item_id = l.dst WHERE l.term = 'dcterms:isPartOf' AND i.class_term = 'foaf:Project'),
k AS (SELECT m.entity, l.* FROM m JOIN links l ON l.src = m.item_id)
SELECT entity, 'timeline' AS chart, count(DISTINCT i.year) AS rows FROM m JOIN items i ON i.item_id = m.item_id WHERE i.year <> 0 GROUP BY 1
UNION ALL SELECT entity, 'languages', count(DISTINCT dst) FROM k WHERE term = 'dcterms:language' GROUP BY 1
UNION ALL SELECT entity, 'types', count(DISTINCT dst) FROM k WHERE term = 'dcterms:type' GROUP BY 1
UNION ALL SELECT entity, 'roles', count(DISTINCT term) FROM k WHERE credit GROUP BY 1
UNION ALL SELECT entity, 'choropleth', count(DISTINCT country) FROM k JOIN cell ON cell.item_id = k.dst WHERE term = 'dcterms:spatial' GROUP BY 1
""")
def project_dashboard_sizes(c):
    pages = dashboards.bundled(dashboards.charts(c, "projects", _countries(c), _ONLY))
    return pages.groupBy("entity", "chart").agg(F.sum("rows").alias("rows"))
