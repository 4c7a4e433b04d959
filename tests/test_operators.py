"""Rules that the star schema doesn't exercise, on small rows of their own."""

import dataclasses
import datetime
import json
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.corpus import SCHEMAS, Corpus
from folioscope.functions import columns as C
from folioscope.operators import compare, dist, flows, geo, graphs, knowledge, network, temporal, text, vectors
from folioscope.plans import publish
from folioscope.sources import bridge, eav


def corpus(spark, items, links, literals=(), records=None, **more):
    """items: (id, title, class) rows; links: (src, term, dst)."""
    made = {
        "items": [(i, t, None, c, None, y) for i, t, c, y in items],
        "links": [(s, t, d, k) for k, (s, t, d) in enumerate(links)],
        "literals": [(i, t, v, k) for k, (i, t, v) in enumerate(literals)],
        "memberships": [], "geo": [], "temporal": [],
    } | more
    frames = {k: spark.createDataFrame(made[k], SCHEMAS[k]) for k in SCHEMAS}
    ids = records if records is not None else [i for i, *_ in items]
    return Corpus(**frames, records=spark.createDataFrame([(i,) for i in ids], "item_id long"))


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_bridge_is_sound(spark, sf):
    assert not any(bridge.load(spark, sf).validate().values())


def test_natural_order_and_durations(spark):
    df = spark.createDataFrame([("Item 10",), ("item 2",), ("Item 1b",)], "t string")
    assert [r.t for r in df.orderBy(C.natural_key(F.col("t"))).collect()] == ["Item 1b", "item 2", "Item 10"]
    d = spark.createDataFrame([("PT1H2M3S", 3723), ("pt5m", 300), ("PT", 0), ("P1DT1H", 0), ("", 0)], "t string, s long")
    assert d.where(C.iso_seconds(F.col("t")) != F.col("s")).count() == 0


def test_months_overflow(spark):
    df = spark.createDataFrame([(datetime.date(2026, 5, 31),)], "d date")
    assert df.select(C.minus_months(F.col("d"), 3)).first()[0] == datetime.date(2026, 3, 3)


def test_roles(spark):
    terms = [(C.CREATOR, True), ("marcrel:aut", True), ("marcrel:pup", False), (C.SUBJECT, False), (C.EDITORS, True)]
    df = spark.createDataFrame(terms, "t string, yes boolean")
    assert df.where(C.is_credit(F.col("t")) != F.col("yes")).count() == 0
    assert df.where(F.col("t") == C.EDITORS).select(C.role_label(F.col("t"))).first()[0] == "editor"


def test_credits_are_one_dimension_and_roles_are_statements(spark):
    c = corpus(spark, [(1, "x", None, 2001), (9, "Ann", C.PERSON, None)], [(1, C.CREATOR, 9), (1, "marcrel:aut", 9)], records=[1])
    assert rows(dist.dimension(c, "contributors"), "item_id", "n") == [(9, 1)]
    assert rows(dist.roles(c)) == [("aut", 1), ("creator", 1)]


def test_literals_join_the_record_they_spell(spark):
    items = [(1, "a", None, None), (2, "b", None, None), (9, "Acme", C.ORGANISATION, None)]
    c = corpus(spark, items, [(1, C.PUBLISHER, 9)], [(2, C.PUBLISHER, " acme "), (2, C.PUBLISHER, "Other")], records=[1, 2])
    assert rows(dist.top_values(c, [C.PUBLISHER]), "value", "item_id", "n") == [("Acme", 9, 2), ("Other", None, 1)]
    assert dist.count_distinct_values(c, [C.PUBLISHER]).first().n == 2


def test_first_and_last_project(spark):
    items = [(1, "x", None, None), (5, "P5", C.PROJECT, None), (6, "P6", C.PROJECT, None), (7, "T", None, None), (9, "Ann", C.PERSON, None)]
    links = [(1, C.IS_PART_OF, 6), (1, C.IS_PART_OF, 5), (1, C.TYPE, 7), (1, C.CREATOR, 9)]
    c = corpus(spark, items, links, records=[1])
    assert rows(flows.treemap(c), "project") == [("P6",)]
    assert ("Ann", "P5", 1) in rows(flows.sankey(c))
    assert rows(network.person_project(c), "person", "project", "n") == [(9, 5, 1)]


def test_small_answers_are_empty(spark):
    c = corpus(spark, [(1, "x", None, 2001), (2, "S", None, None)], [(1, C.SUBJECT, 2)], records=[1])
    assert dist.templates(c).count() == temporal.language_timeline(c).count() == temporal.subject_trends(c).count() == 0
    assert dist.boxplot(spark.createDataFrame([("a", 1)], "label string, value long")).count() == 0
    assert network.chord(c, C.SUBJECT).count() == 0


def test_content_sources_fold_beyond_twelve(spark):
    df = lambda n: spark.createDataFrame([(k, f"g{k:02}") for k in range(n)], "item_id long, label string")
    assert flows.content_sources(df(12)).count() == 12
    thirteen = dict(rows(flows.content_sources(df(13))))
    assert len(thirteen) == 12 and thirteen["Other"] == 2


def test_place_chain_ends_at_a_loop(spark):
    items = [(k, f"p{k}", C.LOCATION, None) for k in (1, 2, 3)]
    c = corpus(spark, items, [(1, C.IS_PART_OF, 2), (2, C.IS_PART_OF, 3), (3, C.IS_PART_OF, 1)])
    assert rows(geo.place_chain(c).where("item_id = 1"), "place", "level") == [(1, 0), (2, 1), (3, 2)]


def test_point_in_polygon_takes_the_first_outline(spark):
    ring = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    outlines = spark.createDataFrame([("hole", [ring(0.0, 10.0), ring(4.0, 6.0)]), ("all", [ring(0.0, 10.0)])], "name string, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 50.0, 50.0), (4, None, 1.0)], "item_id long, lat double, lon double")
    assert rows(geo.country_index(points, outlines)) == [(1, "all"), (2, "hole")]


def test_points_by_the_grid_are_those_by_all_edges(spark):
    """Ragged outlines with holes that overlap, points on edges and corners of cells among them; cells of several sizes."""
    rng = random.Random(9)

    def ring(x, y, r, k):
        at = sorted(rng.uniform(0, 2 * np.pi) for _ in range(k))
        points = [[float(x + r * rng.uniform(0.5, 1) * np.cos(t)), float(y + r * rng.uniform(0.5, 1) * np.sin(t))] for t in at]
        return [*points, points[0]]

    shapes = [(f"c{k}", [ring(x, y, 9, 30), ring(x, y, 2, 8)]) for k, (x, y) in enumerate((rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(12))]
    shapes.append(("square", [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]))
    where = [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(1500)] + [(float(a), float(b)) for a in range(-2, 6) for b in range(-2, 6)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(where)] + [(9999, None, 1.0)], "item_id long, lat double, lon double")
    outlines = spark.createDataFrame(shapes, "name string, rings array<array<array<double>>>")

    def inside(x, y, rings):
        odd = False
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    odd = not odd
        return odd

    want = sorted(((k, next(n for n, r in shapes if inside(lon, lat, r))) for k, (lat, lon) in enumerate(where) if any(inside(lon, lat, r) for _, r in shapes)), key=repr)
    assert len(want) > 300
    for size in (1.0, 0.25, 5.0):
        assert rows(geo.country_index(points, outlines, size), "item_id", "country") == want
    assert rows(geo.country_index(points, outlines.limit(0))) == []


def test_mentions(spark):
    """Names of several words, the longest one only, names that take away, addresses cut out first."""
    gazetteer = [("Sudan", "Sudan", 1), ("South Sudan", "South Sudan", None), ("Niger", "Niger", 1), ("Niger", "River Niger", 0), ("Niger", "Niger Delta", 0), ("Congo", "Congo", 1), ("Congo", "Republic of the Congo", 1)]
    texts = [
        (1, "Sudan, South Sudan; Sudan and\nSouth   Sudan. South Sudan Sudanese Sudan-based Sudan"),
        (2, "Niger. River Niger and the Niger Delta, Niger: Niger"),
        (3, "Republic of the Congo, Congo (Congo)"),
        (4, "Box 1, Niger. Box 22, Niger. Niger Niger"), (5, None), (6, ""),
    ]
    df = spark.createDataFrame(texts, "item_id long, text string")
    names = spark.createDataFrame(gazetteer, "place string, name string, weight int")
    assert rows(geo.mentions(df, names, r"Box [0-9]+, \w+")) == sorted([(1, "Sudan", 3), (1, "South Sudan", 3), (2, "Niger", 3), (3, "Congo", 3)], key=repr)
    assert rows(geo.mentions(df, names, min_mentions=4)) == [(4, "Niger", 4)]


def test_outlines_are_read(spark, tmp_path):
    shape = {"type": "Feature", "properties": {"NAME": "N"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}
    (tmp_path / "o.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [shape]}))
    assert [(r.name, len(r.rings)) for r in geo.read_outlines(spark, str(tmp_path / "o.geojson")).collect()] == [("N", 1)]


def test_postings_are_sampled_evenly(spark):
    n = 700
    c = corpus(spark, [(k, "x", None, None) for k in range(n)] + [(9999, "S", None, None)], [(k, C.SUBJECT, 9999) for k in range(n)])
    got = [r.src for r in knowledge.postings(c).orderBy("src").collect()]
    assert got == [i * n // 256 for i in range(256)]


def test_shared_items_count_every_resource(spark):
    """Against brute force, in several blocks, with a resource beyond any former cap."""
    from folioscope.plans import places_graphs

    rng = random.Random(1)
    items = [(i, "x", None, None) for i in range(1, 781)]
    links = sorted({(s, C.SUBJECT, 901) for s in range(1, 761)} | {(s, C.CREATOR, 910 + rng.randrange(60)) for s in range(1, 781) for _ in range(2)} | {(s, C.SPATIAL, 990) for s in range(700, 781)})
    c = corpus(spark, items + [(i, "r", None, None) for i in range(900, 1000)], links, records=range(1, 781))
    idf = {r.resource: r.idf for r in knowledge.resource_stats(c).collect()}
    of = defaultdict(set)
    for s, _, d in links:
        of[s].add(d)
    want = {}
    for s in range(1, 781):
        found = [(-round(sum(idf[r] for r in of[s] & of[o]), 2), o, len(of[s] & of[o])) for o in range(1, 781) if o != s and of[s] & of[o]]
        want[s] = [(s, o, -w, k, i + 1) for i, (w, o, k) in enumerate(sorted(found)[:90])]
    columns = ("center", "item_id", "strength", "shared", "rank")
    got = rows(knowledge.shared_items(c, blocks=(300, 200)), *columns)
    assert got == sorted((r for part in want.values() for r in part), key=repr)
    assert rows(places_graphs.kg_shared_items(c), *columns) == got
    assert rows(places_graphs.kg_stats(c), "center", "max_strength") == sorted(((s, part[0][2]) for s, part in want.items()), key=repr)


def test_shared_items_by_rare_and_common_resources(spark):
    """Each set of common resources meets the others once, whatever records have it, and the answer stays that of brute force."""
    rng = random.Random(2)
    n = 400
    links = set()
    for s in range(1, n + 1):
        links |= {(s, C.SPATIAL, 901 + s % 4)} | {(s, C.SUBJECT, 910 + rng.randrange(5)) for _ in range(rng.randrange(3))}
        links |= {(s, C.CREATOR, 930 + rng.randrange(60))} if s % 3 else set()
    links |= {(s, C.SERIES, 929) for s in range(1, n + 1)}  # all have it: no strength, but shared
    c = corpus(spark, [(i, "x", None, None) for i in range(1, n + 1)], sorted(links), records=range(1, n + 1))
    idf = {r.resource: r.idf for r in knowledge.resource_stats(c).collect()}
    of = defaultdict(set)
    for s, _, d in links:
        of[s].add(d)
    for least, top in ((0.0, 90), (1.5, 7)):
        want = []
        for s in range(1, n + 1):
            found = [(-round(sum(idf[r] for r in of[s] & of[o]), 2), o, len(of[s] & of[o])) for o in range(1, n + 1) if o != s]
            want += [(s, o, -w, k, i + 1) for i, (w, o, k) in enumerate(sorted(f for f in found if -f[0] >= least)[:top])]
        for rare in (0, 30, 1000):
            got = knowledge.shared_items(c, top=top, min_strength=least, blocks=(100, 80), rare=rare)
            assert rows(got, "center", "item_id", "strength", "shared", "rank") == sorted(want, key=repr)
    sets = {tuple(sorted(r for r in found if sum(r in x for x in of.values()) > 30)) for found in of.values()}
    made = []
    real = knowledge._of_sets
    try:
        knowledge._of_sets = lambda wide, *a: made.append(wide.count()) or real(wide, *a)
        knowledge.shared_items(c, rare=30)
    finally:
        knowledge._of_sets = real
    assert made == [len(sets)] and len(sets) < n / 4


def test_best_of_a_set_is_one_row(spark):
    """What a block gives a set is one row of arrays, of records and not of sets."""
    sets = spark.createDataFrame([(1, [901], [5], 0, [1, 4]), (2, [901, 902], [5, 7], 0, [2])], "item_id long, resources array<long>, cents array<long>, least long, ids array<long>")
    got = knowledge._of_sets(sets, 3, (1, 8)).orderBy("center").collect()
    assert [tuple(r) for r in got] == [(1, [1, 2, 4], [5, 5, 5], [1, 1, 1]), (2, [2, 1, 4], [12, 5, 5], [2, 1, 1])]


def test_strongest_leaves_segments_out(monkeypatch):
    """Candidates in several segments, with dense and sparse resources and in either type of number, against brute force."""
    rng = np.random.default_rng(3)
    n, top = 700, 20
    monkeypatch.setattr(knowledge, "_SEGMENT", 64)
    weight = {r: 700 - r for r in range(400)}
    for scale in (1, 5000):
        own = [np.array(sorted({int(rng.integers(25)) + 300, *(int(x) + 330 for x in rng.integers(25, size=3)), int(rng.integers(300))})) for _ in range(n)]
        rows_of = pd.DataFrame({"item_id": rng.permutation(n) * 3, "resources": own, "cents": [np.array([weight[r] * scale for r in x]) for x in own], "least": rng.integers(0, 900, n) * scale})
        got = knowledge._strongest(rows_of, rows_of, top).sort_values(["center", "cents", "item_id"], ascending=[True, False, True])
        want = []
        for i, least, mine in zip(rows_of["item_id"], rows_of["least"], own):
            found = [(-sum(weight[r] * scale for r in set(mine) & set(x)), j, len(set(mine) & set(x))) for j, x in zip(rows_of["item_id"], own) if j != i]
            want += [(i, j, -w, k) for w, j, k in sorted(f for f in found if f[2] and -f[0] >= least)[:top]]
        assert list(got.itertuples(index=False, name=None)) == sorted(want, key=lambda r: (r[0], -r[2], r[1]))


def test_counts_of_pairs_are_dealt_by_the_rows_made(spark, monkeypatch):
    """A pair that many records have is one row, and the count goes to as many tasks as the join, not to Spark's number of shuffle partitions."""
    monkeypatch.setattr(network, "MET", 50)
    said = [(s, d) for s in range(100) for d in (1, 2, 10 + s, 200 + s % 7)]
    got = network.pairs(spark.createDataFrame(said, "src long, dst long"), [])
    want = defaultdict(int)
    for s in range(100):
        mine = sorted(d for x, d in said if x == s)
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                want[a, b] += 1
    assert rows(got, "a", "b", "n") == sorted(((a, b, n) for (a, b), n in want.items()), key=repr)
    assert got.rdd.getNumPartitions() == 100 * 16 // 50


def test_cross_edges(spark):
    """In the order of gathering, by the first statement in reading order, without what is drawn, and up to the caps."""
    items = [(k, f"x{k}", None, None) for k in range(1, 6)]
    statements = [(1, C.SUBJECT, 5), (1, C.SUBJECT, 2), (1, C.CREATOR, 3), (2, C.TYPE, 3), (2, C.IS_PART_OF, 3), (3, C.SUBJECT, 2), (5, C.SUBJECT, 2), (2, C.SUBJECT, 1), (5, C.SUBJECT, 4)]
    c = corpus(spark, items, statements, records=[1])
    nodes = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (1, 5, 3)], "center long, item_id long, seq long")
    none = spark.createDataFrame([], "center long, a long, b long")
    of = lambda *a, **b: rows(knowledge.cross_edges(c, nodes, *a, **b), "center", "source", "target", "term", "rank")
    first, second = (1, 3, 2, C.SUBJECT, 1), (1, 5, 2, C.SUBJECT, 2)
    assert of(none) == [first, second]  # 3 was gathered before 2, so its statement is the edge
    assert of(none, top=1) == [first] and of(none, scanned=1) == [first]
    assert of(spark.createDataFrame([(1, 2, 3)], "center long, a long, b long")) == [(*second[:4], 1)]


def test_graph_makes_only_the_parts_asked_for(spark, monkeypatch):
    """Nodes need no edges; edges of centres dealt to many tasks are ranked within each centre, once for both directions and not where they are drawn."""
    made = []
    for name in ("shared_edges", "cross_edges"):
        monkeypatch.setattr(knowledge, name, lambda *_, name=name: made.append(name))
    items = [(k, f"I{k}", None, None) for k in (1, 2, 3)]
    c = corpus(spark, items, [(1, C.SUBJECT, 3), (2, C.SUBJECT, 3)], records=[1, 2])
    assert rows(knowledge.assembled(c).nodes, "center", "item_id", "seq") == [(1, 2, 2), (1, 3, 1), (2, 1, 2), (2, 3, 1), (3, 1, 1), (3, 2, 2)] and not made
    monkeypatch.undo()
    monkeypatch.setattr(knowledge, "_HELD_NODES", 2)
    c = corpus(spark, [(k, f"I{k}", None, None) for k in range(1, 6)], [(1, C.SUBJECT, 2), (2, C.SUBJECT, 1), (2, C.TYPE, 3), (3, C.SUBJECT, 4)], records=[])
    nodes = spark.createDataFrame([(z, k, k) for z in range(10, 30) for k in (1, 2, 3, 4)], "center long, item_id long, seq long")
    drawn = spark.createDataFrame([(z, 4, 3) for z in range(10, 20)], "center long, a long, b long")
    got = rows(knowledge.cross_edges(c, nodes, drawn), "center", "source", "target", "term", "rank")
    assert got == sorted([(z, 1, 2, C.SUBJECT, 1) for z in range(10, 30)] + [(z, 2, 3, C.TYPE, 2) for z in range(10, 30)] + [(z, 3, 4, C.SUBJECT, 3) for z in range(20, 30)])


def test_nodes_are_gathered_once_in_order(spark):
    of = lambda x, more: spark.createDataFrame(x, f"center long, item_id long, rank long{more}")
    named = ", category string"
    nodes = knowledge.gathered(
        of([(1, 3, 1, "Person"), (1, 2, 2, "Subject"), (1, 1, 3, "Subject")], named), of([(1, 2, 1, "Project"), (1, 4, 2, "Project")], named),
        of([(1, 4, 1), (1, 6, 2)], ""), of([(1, 2, 1, 2.5, 3), (1, 5, 2, 1.0, 1)], ", strength double, shared long"),
    )
    assert [tuple(r) for r in nodes.orderBy("seq").collect()] == [
        (1, 3, "Person", None, None, 1), (1, 2, "Subject", 2.5, 3, 2), (1, 4, "Project", None, None, 3), (1, 6, "Research Item", None, None, 4), (1, 5, "Shared Item", 1.0, 1, 5),
    ]


def test_people_of_a_project_and_newest_projects(spark):
    """Only a project's own statements count, names go in reading order; equal counts go by id."""
    day = datetime.date(2026, 1, 2)
    kinds = [(1, "rec", None), (10, "P ten", C.PROJECT), (11, "A eleven", C.PROJECT), (20, "Zoe", C.PERSON), (21, "Ann", C.PERSON), (22, None, C.PERSON), (30, "Inst", C.ORGANISATION), (31, "Place", C.LOCATION)]
    items = [(i, t, None, k, day if i in (1, 2) else None, None) for i, t, k in [*kinds, (2, "rec", None)]]
    statements = [
        (1, C.IS_PART_OF, 10), (2, C.IS_PART_OF, 11), (1, C.CREATOR, 21), (10, C.MEMBER, 20), (10, C.CREATOR, 21), (10, C.MEMBER, 22), (10, C.CREATOR, 20),
        *((p, C.IS_PART_OF, o) for p in (20, 21, 22) for o in (30, 31)),
    ]
    c = corpus(spark, [], statements, records=[1, 2], geo=[(30, 1.0, 2.0), (31, 3.0, 4.0)])
    c = dataclasses.replace(c, items=spark.createDataFrame(items, SCHEMAS["items"]))
    got = rows(geo.project_affiliation_map(c), "project", "institution", "name", "lat", "lon", "members")
    assert got == [(10, 30, "Inst", 1.0, 2.0, ["Zoe", "Ann"])]
    assert rows(temporal.whats_new_projects(c).where("months = 3"), "rank", "item_id", "n") == [(1, 10, 1), (2, 11, 1)]


def two_cliques():
    edges = [(a, b, 1) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)]
    return edges + [(4, 10, 1)]


@pytest.mark.parametrize("method", ["one-level", "louvain", "propagation"])
def test_communities(spark, method):
    bridge_too = method != "propagation"  # with ties to the lowest label one bridge is enough to spread it
    df = spark.createDataFrame(two_cliques()[: None if bridge_too else -1], "a long, b long, n long")
    found = dict(rows(graphs.communities(df, method), "node", "community"))
    assert len({found[k] for k in range(5)}) == len({found[k] for k in range(10, 15)}) == 1 and found[0] != found[10]


def test_shown_graph_takes_ties_of_two_records(spark):
    from folioscope.plans import texts_vectors

    people = [(i, "p", C.PERSON, None) for i in range(11, 17)]
    links = [(r + 10 * k, C.CREATOR, p) for k in range(2) for r, pair in enumerate([(11, 12), (12, 13), (14, 15)], 100) for p in pair] + [(150, C.CREATOR, 15), (150, C.CREATOR, 16)]
    records = sorted({s for s, *_ in links})
    c = corpus(spark, people + [(i, "r", None, None) for i in records], links, records=records)
    for query in (texts_vectors.louvain, texts_vectors.louvain_multilevel, texts_vectors.label_propagation):
        assert rows(query(c), "node", "community") == [(11, 0), (12, 0), (13, 0), (14, 1), (15, 1)]
    assert rows(texts_vectors.connected_top_n(c), "node") == rows(texts_vectors.force_layout(c), "node") == [(11,), (12,), (13,), (14,), (15,)]


def test_shown_graph_is_ranked_and_laid_out_to_the_end(spark):
    from folioscope.plans import texts_vectors

    # A long tail on a dense head: positions still move after 60 rounds.
    pairs = [(a, b) for a in range(11, 31) for b in range(a + 1, 31) if (a * b) % 3] + [(i, i + 1) for i in range(30, 90)]
    links = [(1000 + 2 * k + j, C.CREATOR, p) for k, pair in enumerate(pairs) for j in range(2) for p in pair]
    records = sorted({s for s, *_ in links})
    c = corpus(spark, [(i, "p", C.PERSON, None) for i in range(11, 91)] + [(i, "r", None, None) for i in records], links, records=records)
    edges = network.collaboration(c)
    want = graphs.connected_top_n(edges, graphs.pagerank(edges, iterations=20), 40)
    assert rows(texts_vectors.connected_top_n(c), "node", "place") == rows(want, "node", "place")
    got, short = rows(texts_vectors.force_layout(c)), rows(graphs.layout(edges, iterations=60))
    assert got == rows(graphs.layout(edges, iterations=520)) and got != short


def test_ego_keeps_25_partners(spark):
    from folioscope.plans import networks

    items = [(i, "o", C.ORGANISATION, None) for i in range(1, 29)]
    links = [(100 + o, C.FUNDER, x) for o in range(2, 29) for x in (1, o)] + [(r, C.FUNDER, x) for r in (201, 202) for x in (25, 26)]
    records = sorted({s for s, *_ in links})
    c = corpus(spark, items + [(i, "r", None, None) for i in records], links, records=records)
    assert rows(networks.collab_ego(c).where("entity = 1"), "rank", "other") == sorted(((k, k + 1) for k in range(1, 26)), key=repr)
    assert rows(networks.collab_ego_extra(c).where("entity = 1"), "a", "b", "n") == [(25, 26, 2)]


def test_communities_by_key(spark):
    df = spark.createDataFrame([(k, a, b, n) for k in (1, 2) for a, b, n in two_cliques()], "center long, a long, b long, n long")
    assert graphs.communities(df, "louvain", key="center").groupBy("center").count().where("count = 10").count() == 2


def test_pagerank_is_the_eigenvector(spark):
    rng = random.Random(1)
    edges = {(a, b): rng.randint(1, 5) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.5} | {(0, k): 1 for k in range(1, 12)}
    w = np.zeros((12, 12))
    for (a, b), n in edges.items():
        w[a, b] = w[b, a] = n
    p = np.full(12, 1 / 12)
    for _ in range(200):
        p = 0.15 / 12 + 0.85 * (w / w.sum(0)) @ p
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "a long, b long, n long")
    got = dict(rows(graphs.pagerank(df, iterations=30)))
    assert max(abs(got[k] - p[k]) for k in range(12)) < 1e-4


def test_connected_top(spark):
    graph = graphs._adjacency(*zip(*[(1, 2, 1), (2, 3, 1), (8, 9, 1)]))
    score = {1: 1, 2: 5, 3: 2, 8: 4, 9: 3}
    assert graphs.connected_top(graph, score, 3) == [2, 3, 1]
    assert graphs.connected_top(graph, score, 4) == [2, 3, 1]
    assert graphs.connected_top(graph, score, 5) == [2, 3, 1, 8, 9]


def test_layout_is_stable_and_bounded(spark):
    df = spark.createDataFrame(two_cliques(), "a long, b long, n long")
    one, two = rows(graphs.layout(df, 50)), rows(graphs.layout(df, 50))
    assert one == two and all(-180 <= lon <= 180 and -90 <= lat <= 90 for _, lon, lat in one)


def test_passages(spark):
    words = lambda n, w: " ".join([w] * n)
    body = "\n\n".join([words(200, "a"), words(150, "b"), words(350, "c"), "12", words(50, "d")])
    df = spark.createDataFrame([(1, body), (2, "")], "item_id long, text string")
    assert rows(text.passages(df), "item_id", "idx", "words") == [(1, 0, 350), (1, 1, 400)]
    long = spark.createDataFrame([(3, " ".join([words(99, "e") + "."] * 9))], "item_id long, text string")
    sizes = [r.words for r in text.passages(long).orderBy("idx").collect()]
    assert sizes == [396, 495]  # the last 99 words join the passage before them


def test_repeated_short_lines_go(spark):
    df = spark.createDataFrame([(1, "Head\n\nbody text here is long enough to stay put\n\nHead\n\nHead\n\nonce")], "item_id long, text string")
    assert [r.text for r in text.paragraphs(df).orderBy("pos").collect()] == ["body text here is long enough to stay put", "once"]


def test_word_rules(spark):
    df = spark.createDataFrame([(1, "[Music] Speaker 1: Women women STUDIES study the the ab")], "item_id long, text string")
    assert rows(text.word_cloud(df), "word", "n") == [("study", 2), ("woman", 2)]
    langs = spark.createDataFrame([(1, "the and of cat"), (2, "the and of les des une dans"), (3, "the of")], "item_id long, text string")
    assert rows(text.detect_language(langs)) == [(1, "en"), (2, None), (3, None)]


def test_keywords_do_not_nest(spark):
    """Against the greedy choice over the whole list, where nested terms fill the first places."""
    rng = random.Random(5)
    terms = [" ".join(rng.sample(["alpha", "beta", "gamma", "delta", "eps", "alphabet", "zeta"], rng.choice([1, 2]))) for _ in range(60)]
    scored = sorted({(g, t, float(rng.randrange(20))) for g in ("a", "b", None) for t in set(terms)}, key=lambda r: (str(r[0]), -r[2], r[1]))
    want = []
    for g in ("a", "b", None):
        chosen = []
        for _, t, x in [r for r in scored if r[0] == g]:
            if len(chosen) < 4 and not any(t in o or o in t for o, _ in chosen):
                chosen.append((t, x))
        want += [(g, t, x, i) for i, (t, x) in enumerate(chosen, 1)]
    got = text.unnested(spark.createDataFrame(scored, "g string, term string, score double"), "g", 4)
    assert rows(got, "g", "term", "score", "rank") == sorted(want, key=repr)
    docs = [(i, "heavy metal heavy metal heavy metal" if i % 2 else "quiet", "x") for i in range(10)] + [(20 + i, "filler words only", "y") for i in range(10)]
    found = [r.term for r in text.keywords(spark.createDataFrame(docs, "item_id long, text string, g string"), "g", top=3).where("g = 'x'").collect()]
    assert found == ["heavy", "metal", "quiet"]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8)).round(2)
    v[7] = v[3]
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)], "item_id long, vector array<double>")
    got = {}
    for r in vectors.similar_items(df, top=5, block=16).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(60):
        s = np.round(u @ u[k], 6)
        seen, want = set(), []
        for j in sorted(range(60), key=lambda j: (-s[j], j)):
            if s[j] > 0 and tuple(v[j]) != tuple(v[k]) and tuple(v[j]) not in seen:
                seen.add(tuple(v[j]))
                want.append(j)
        assert [j for _, j in sorted(got[k])] == want[:5]


def test_overlap_and_alignment(spark):
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "z")], "entity long, name string")
    assert rows(compare.overlap(sets)) == [(1, 2, 1, 3, 33)]
    assert [r.name for r in compare.shared_names(sets, 1, 2).collect()] == ["b"]
    a = spark.createDataFrame([("x", 2), ("y", 0)], "name string, n long")
    b = spark.createDataFrame([("w", 5), ("y", 0)], "name string, n long")
    assert rows(compare.unified(a, b), "name", "a", "b") == [("w", 0, 5), ("x", 2, 0)]
    assert compare.search(spark.createDataFrame([(1, "Abc")], "item_id long, title string"), "b").count() == 0


def relational(spark):
    t = {
        "resource": [(1, "secret", 10, 5, "2020-01-02T00:00:00", 1, "item"), (2, "t", None, None, "2020-01-02", 0, "item"), (3, "t", None, None, "2020-01-02", 1, "item"), (4, "t", None, None, "2020-01-02", 1, "item"), (50, "s", None, None, "2020-01-02", 1, "item_set")],
        "item": [(1, None), (2, None), (3, None), (4, None)],
        "site": [(7, 1), (8, 0)],
        "item_site": [(1, 7), (2, 7), (3, 7), (4, 8)],
        "vocabulary": [(1, "dcterms"), (2, "geo"), (3, "foaf"), (4, "own")],
        "property": [(1, 1, "title", "Title"), (2, 1, "subject", "Subject"), (3, 2, "lat", "Lat"), (4, 2, "long", "Long"), (5, 1, "date", "Date"), (6, 1, "issued", "Issued"), (7, 1, "temporal", "When"), (8, 1, "alternative", "Alt"), (9, 1, "isPartOf", "Part"), (10, 4, "id", "Code")],
        "resource_class": [(5, 3, "Project", "Project")],
        "resource_template": [(10, "T", 8)],
        "value": [
            (1, 1, 1, None, "plain", None, 1), (2, 1, 8, None, "hidden", None, 0), (3, 1, 8, None, "own", None, 1), (4, 1, 2, 3, None, None, 1), (5, 1, 2, 3, None, None, 1), (6, 1, 2, 2, None, None, 1),
            (7, 1, 3, None, "99", None, 1), (8, 1, 4, None, "5", None, 1), (9, 1, 3, None, "10.5", None, 1), (10, 1, 4, None, "20", None, 1), (11, 1, 5, None, "in 1999", None, 1), (12, 1, 6, None, "soon", None, 1), (13, 1, 6, None, "2001-05", None, 1),
            (14, 1, 7, None, "a", None, 1), (15, 1, 7, None, "2001 / 2003", None, 1), (16, 50, 10, None, " X1 ", None, 1), (17, 50, 1, None, "Set", None, 1),
        ],
        "item_item_set": [(1, 50), (1, 50), (2, 50)],
        "media": [],
    }
    schemas = {
        "resource": "id long, title string, resource_template_id int, resource_class_id int, created string, is_public int, resource_type string",
        "item": "id long, primary_media_id long", "site": "id int, is_public int", "item_site": "item_id long, site_id int", "vocabulary": "id int, prefix string",
        "property": "id int, vocabulary_id int, local_name string, label string", "resource_class": "id int, vocabulary_id int, local_name string, label string",
        "resource_template": "id int, label string, title_property_id int", "value": "id long, resource_id long, property_id int, value_resource_id long, value string, uri string, is_public int",
        "item_item_set": "item_id long, item_set_id long", "media": "id long, item_id long, storage_id string, extension string, has_thumbnails int, has_original int, position int",
    }
    return {k: spark.createDataFrame(t[k], schemas[k]) for k in schemas}


def test_relational_load(spark):
    t = relational(spark)
    c = eav.load(t, 7, local_prefix="own")
    assert rows(c.items, "item_id", "title", "class_term", "year") == [(1, "own", "foaf:Project", 2001), (3, "Item 3", None, None)]
    assert rows(c.links, "src", "term", "dst", "ord") == [(1, "dcterms:subject", 3, 4)]
    assert rows(c.geo) == [(1, 10.5, 20.0)] and rows(c.temporal) == [(1, "2001", "2003")] and rows(c.memberships) == [(50, 1)]
    assert not any(c.validate().values())
    with pytest.raises(ValueError):
        eav.load(t, 8)


def test_project_collections(spark):
    sets = spark.createDataFrame([(50, "X1", [7]), (51, "X2", []), (52, "X2", None), (53, "X1", [])], "set_id long, code string, part_of array<long>")
    projects = spark.createDataFrame([(7, "X1"), (8, " X2"), (9, "X2")], "item_id long, code string")
    assert rows(eav.project_collections(sets, projects)) == [(7, 50), (8, 51), (8, 52)]


def test_publishing(spark, tmp_path):
    store = publish.Store(tmp_path)
    one = spark.createDataFrame([(1, "a")], "n long, t string")
    first = store.publish({"a/x.json": one, "b.json": one.limit(0)}, required=("a/x.json",))
    assert store.read("a/x.json") == [{"n": 1, "t": "a"}]
    assert store.read("b.json") is None and store.read("../manifest.json") is None
    assert store.publish({"a/x.json": one}) == first
    with pytest.raises(ValueError):
        store.publish({"b.json": one}, required=("a/x.json",))
    assert store.read("a/x.json")
    for k in range(3):
        store.publish({"a/x.json": one.withColumn("k", F.lit(k))})
    assert len(list((tmp_path / "generations").iterdir())) == 2
    assert publish.accepted({"siteId": 1, "revision": "r", "profile": "p", "rows": [1]}, 1, "r", "p") == [1]
    assert publish.accepted({"siteId": 1, "revision": "r", "profile": "p", "rows": [1]}, 2, "r", "p") == []


def test_stream_gives_what_the_batch_gives(spark, sf, tmp_path):
    from folioscope.streaming import windows

    events = spark.read.parquet(f"{sf}/events.parquet")
    late = events.agg(F.max("ts")).first()[0] + datetime.timedelta(days=60)
    end = events.limit(1).withColumn("ts", F.lit(late)).withColumn("event_type", F.lit("end"))
    for k, df in enumerate((events, end)):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.daily(stream).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = rows(spark.table("days").where("event_type != 'end'"))
    finally:
        q.stop()
    assert got == rows(windows.daily(events))


def test_members_of_projects_and_sections_are_of_the_cluster(spark):
    items = [(1, "a", C.PERSON, None), (2, "b", C.PERSON, None), (3, "c", C.PERSON, None), (4, "d", C.PERSON, None), (10, "P", C.PROJECT, None), (11, "S", C.GROUP, None), (12, "O", C.ORGANISATION, None), (13, "Centre", C.ORGANISATION, None)]
    c = corpus(spark, items, [(10, C.MEMBER, 1), (11, C.MEMBER, 2), (12, C.MEMBER, 3), (4, C.IS_PART_OF, 13)])
    core = spark.createDataFrame([(13,)], "item_id long")
    assert rows(network.person_class(c, core)) == [(1, "cluster"), (2, "cluster"), (3, "partner"), (4, "cluster")]


def test_repulsion_by_a_tree_is_near_the_exact_one():
    from folioscope.operators.repulsion import exact_repulsion, repulsion

    i = np.arange(600)
    at, mass = np.stack([np.sqrt(i + 1) * np.cos(i * 2.39996), np.sqrt(i + 1) * np.sin(i * 2.39996)], 1), 1.0 + i % 4
    rng = np.random.default_rng(1)
    for p, m in ((at, mass), (rng.normal(size=(1500, 2)) * [100, 3], rng.integers(1, 9, 1500).astype(float)), (np.repeat(rng.normal(size=(40, 2)), 20, 0), np.ones(800))):
        near, exact = repulsion(p, m), exact_repulsion(p, m)
        assert np.hypot(*(near - exact).T).sum() <= 0.03 * np.hypot(*exact.T).sum()
    assert not repulsion(np.zeros((2, 2)), np.ones(2)).any() and not repulsion(np.zeros((50, 2)), np.ones(50)).any()
    assert repulsion(np.zeros((0, 2)), np.zeros(0)).shape == (0, 2)


def test_layout_by_a_tree_is_the_exact_one_at_first():
    a = np.arange(179)
    tree = graphs.force_layout(a, a + 1, np.ones(179), np.arange(180), 8)
    exact = graphs.force_layout(a, a + 1, np.ones(179), np.arange(180), 8, tree_from=1000)
    assert np.abs(tree).max() <= 1 + 1e-9 and np.abs(tree - exact).max() < 0.02
    assert (tree == graphs.force_layout(a, a + 1, np.ones(179), np.arange(180), 8)).all()


def test_pagerank_stops_when_ranks_have_settled(spark):
    df = spark.createDataFrame(two_cliques(), "a long, b long, n long")
    one, two = dict(rows(graphs.pagerank(df))), dict(rows(graphs.pagerank(df, iterations=60, tolerance=0.0)))
    assert max(abs(one[k] - two[k]) for k in one) < 1e-5


def test_outline_names_and_publication_countries(spark):
    rows_ = [("Tanzania", ["United Republic of Tanzania", "Tanzania"], 0), ("Other", ["TANZANIA", "Other"], 1)]
    names = geo.outline_names(spark.createDataFrame(rows_, "name string, aliases array<string>, k int"))
    assert rows(names) == [("other", "Other"), ("tanzania", "Tanzania"), ("united republic of tanzania", "Tanzania")]
    places = [(1, "Tanzania ", C.LOCATION, None), (2, "Dar", C.LOCATION, None), (3, "Nowhere", C.LOCATION, None), (4, "J", C.JOURNAL, None)]
    items = places + [(k, f"r{k}", None, 2000 + k) for k in (10, 11, 12, 13)]
    links = [(2, C.IS_PART_OF, 1), (4, C.SPATIAL, 3), (10, "marcrel:pup", 2), (10, "marcrel:pup", 1), (11, C.IS_PART_OF, 4), (12, C.SPATIAL, 2), (13, "marcrel:pup", 1)]
    c = corpus(spark, items, links, records=[10, 11, 12, 13], geo=[(2, -6.8, 39.3)])
    assert rows(geo.publication_places(c), "src", "place") == [(10, 1), (10, 2), (11, 3), (13, 1)]
    assert rows(geo.publications_by_place(c), "item_id", "n") == [(1, 2), (2, 1), (3, 1)]
    assert rows(geo.publication_countries(c, c.records, names)) == sorted([("Tanzania", "Tanzania", 2, -6.8, 39.3), ("Nowhere", None, 1, None, None)], key=repr)
    assert rows(geo.published_timeline(c).where("entity = 1"), "year", "n") == [(2010, 1), (2013, 1)]


def test_articles_by_country(spark):
    df = spark.createDataFrame([(1, 1991, "X", 3), (2, 1999, "X", 5), (2, 1999, "Y", 4), (3, None, "X", 5)], "item_id long, year int, country string, n long")
    assert rows(geo.articles_by_country(df)) == sorted([(1990, "X", 2), (1990, "Y", 1), (None, "X", 3), (None, "Y", 1)], key=repr)
    assert rows(geo.articles_about(df).where("country = 'X'"), "rank", "item_id") == [(1, 3), (2, 2), (3, 1)]


def test_categories_of_relations(spark):
    items = [(1, "r", None, None), (2, "p", C.PROJECT, None), (3, "x", None, None), (4, "j", C.JOURNAL, None), (5, "o", C.ORGANISATION, None), (6, "l", C.LOCATION, None), (7, "c", "fabio:Book", None)]
    links = [(1, C.IS_PART_OF, k) for k in (2, 3, 4, 5, 6, 7)] + [(1, C.SERIES, 3), (1, C.CREATOR, 5), (1, "marcrel:edt", 5), (1, "marcrel:edt", 3), (1, "marcrel:pup", 6), (1, "dcterms:relation", 3), (1, C.LANGUAGE, 3)]
    got = rows(knowledge.direct_relations(corpus(spark, items, links, records=[1])), "term", "item_id", "category")
    assert got == sorted([
        (C.IS_PART_OF, 2, "Project"), (C.IS_PART_OF, 3, "Project"), (C.IS_PART_OF, 4, "Publication venue"), (C.IS_PART_OF, 5, "Institution"), (C.IS_PART_OF, 6, "Location"),
        (C.IS_PART_OF, 7, "Publication venue"), (C.SERIES, 3, "Publication venue"), (C.CREATOR, 5, "Person"), ("marcrel:edt", 5, "Institution"), ("marcrel:edt", 3, "Contributor"),
        ("marcrel:pup", 6, "Location"), ("dcterms:relation", 3, "Related item"),
    ], key=repr)


def test_newest_items_of_a_day_go_by_id(spark):
    day = datetime.date(2020, 5, 1)
    made = spark.createDataFrame([(3, "a", None, None, day, 2020), (1, "z", None, None, day, 2020), (2, "m", None, None, day, 2020)], SCHEMAS["items"])
    c = corpus(spark, [], [], records=[1, 2, 3])
    c = Corpus(**{k: getattr(c, k) for k in SCHEMAS} | {"items": made}, records=c.records)
    assert rows(temporal.whats_new_items(c, top=2).where("months = 3"), "rank", "item_id") == [(1, 1), (2, 2)]


def test_names_of_answers():
    good = ("a.json", "people/12.json", "x-y/A_b-3.json")
    bad = ("a.json\n", "é.json", "P/a.json", "../a.json", "a/b/c.json", "a.jsonx", "١.json")
    assert all(publish.NAME.fullmatch(n) for n in good) and not any(publish.NAME.fullmatch(n) for n in bad)


def test_graphs_of_centres_have_communities(spark):
    """Two groups of items that share two resources each; the centre itself and lone nodes have none."""
    items = [(k, "i", None, None) for k in range(1, 8)] + [(k, "s", None, None) for k in range(20, 24)]
    links = [(1, C.SUBJECT, s) for s in range(20, 24)] + [(k, C.SUBJECT, s) for k in (2, 3, 4) for s in (20, 21)] + [(k, C.SUBJECT, s) for k in (5, 6) for s in (22, 23)]
    c = corpus(spark, items, links, records=range(1, 8))
    direct, shared = knowledge.direct_relations(c), knowledge.shared_items(c)
    edges = knowledge.shared_edges(c, direct, shared)
    assert rows(edges.where("center = 1"), "item_id", "resource") == sorted([(k, s) for k in (2, 3, 4) for s in (20, 21)] + [(k, s) for k in (5, 6) for s in (22, 23)], key=repr)
    none = spark.createDataFrame([], "center long, source long, target long")
    got = dict(rows(knowledge.graph_communities(edges, none).where("center = 1"), "node", "community"))
    assert got == {2: 0, 3: 0, 4: 0, 20: 0, 21: 0, 5: 1, 6: 1, 22: 1, 23: 1}


def test_shown_networks(spark):
    from folioscope.operators import shown

    people = [(i, f"P{i}", C.PERSON, None) for i in range(11, 17)]
    pairs = [(11, 12), (12, 13), (11, 13), (14, 15), (15, 16), (14, 16), (13, 14)]
    links = [(100 + 2 * k + j, C.CREATOR, p) for k, pair in enumerate(pairs) for j in range(2 if pair != (13, 14) else 1) for p in pair]
    records = sorted({s for s, *_ in links})
    literals = [(100, C.AUTHORS, "P11"), (100, C.AUTHORS, "New Name"), (102, C.EDITORS, "Ed")]
    c = corpus(spark, people + [(i, "r", None, None) for i in records], links, literals, records=records)
    net = shown.collaboration_network(c)
    assert rows(net.links, "a", "b", "n") == sorted([(*p, 2) for p in pairs[:-1]], key=repr)
    got = {r.node: r for r in net.nodes.collect()}
    assert len(got) == 6 and {got[k].community for k in (11, 12, 13)} != {got[k].community for k in (14, 15, 16)} and got[11].n == 4
    assert rows(net.communities, "community", "size", "merged") == [(0, 3, False), (1, 3, False)]
    net = shown.coauthor_network(c, top=5)
    names = {r.name: r for r in net.nodes.collect()}
    assert len(names) == 5 and all(r.a < r.b for r in net.links.collect())
    whole = {r.name: r for r in shown.coauthor_network(c).nodes.collect()}
    assert set(whole) == {"P11", "P12", "P13", "P14", "P15", "P16", "New Name", "Ed"} and whole["Ed"].role == "editor" and whole["Ed"].item_id is None and whole["P11"].item_id == 11
    few = shown.coauthor_network(c, colours=1)
    assert rows(few.communities, "community", "merged", "anchor") == [(0, True, None)]
    assert shown.collaboration_network(c, min_count=3).nodes.count() == 0


def test_dominant_sections(spark):
    made = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (1, 8), (2, 8), (5, 9)], "src long, dst long")
    section = spark.createDataFrame([(1, 100), (2, 100), (3, 200)], "item_id long, section long")
    from folioscope.operators import shown

    assert rows(shown.dominant_sections(made, section)) == [(7, 100), (8, 100), (9, -1)]
    half = spark.createDataFrame([(1, 100), (2, 200)], "item_id long, section long")
    assert rows(shown.dominant_sections(made, half)) == [(7, -2), (8, -2), (9, -1)]


def test_all_entities_of_html(spark):
    df = spark.createDataFrame([("<p>caf&eacute; &#8212; &#x4e2d;&nbsp;&lt;b&gt; &amp;amp; &copy</p><p>AT&T</p>",), (None,), ("plain",)], "h string")
    assert [r[0] for r in df.select(text.strip_html(F.col("h"))).collect()] == ["café — 中 <b> &amp; ©\n\n AT&T\n\n", None, "plain"]


def test_literals_of_unknown_terms_are_a_mistake(spark):
    c = corpus(spark, [(1, "x", None, None)], [], literals=[(1, C.AUTHORS, "Ann")])
    assert c.values(C.AUTHORS).count() == 1
    with pytest.raises(KeyError, match="no:such"):
        c.values(C.AUTHORS, "no:such")


def test_answers_for_spreadsheets(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a", 'say "hi", é', 1), ("b", None, 2)], "series string, category string, value long")
    assert publish.export_csv(df, tmp_path / "x.csv") == 2
    assert (tmp_path / "x.csv").read_bytes() == b'\xef\xbb\xbf"series","category","value"\r\n"a","say ""hi"", \xc3\xa9","1"\r\n"b","","2"\r\n'
    monkeypatch.setattr(publish, "MAX_ROWS", 1)
    with pytest.raises(ValueError, match="write_table"):
        publish.export_csv(df, tmp_path / "y.csv")


def test_places_of_all_nodes_are_numbered_by_ranges(spark):
    from folioscope.operators.shown import _places

    rng = random.Random(3)
    ranks = spark.createDataFrame([(k, rng.choice([0.1, 0.2, 0.30000000001, 0.3])) for k in range(300)], "node long, rank double").repartition(5)
    assert rows(_places(ranks), "node", "place") == rows(_places(ranks, 300), "node", "place")


def test_clouds_by_language(spark):
    """The language of most texts first, marked words on top of the number asked for, and one mixed cloud where no language can be told."""
    en, fr, pt = "the and of that study study cloud cloud rain rain", "les des dans qui pluie pluie nuage nuage", "não uma dos nas chuva chuva"
    df = spark.createDataFrame([(1, fr), (2, en), (3, fr), (4, pt), (5, "los las que con lluvia lluvia"), (6, "nothing told here here")], "item_id long, text string")
    got = rows(text.language_clouds(df, top=2, generic={"en": ("study",)}), "bucket", "lang", "word", "n", "generic", "rank")
    assert got == sorted([
        (1, "fr", "nuage", 4, False, 1), (1, "fr", "pluie", 4, False, 2), (2, "en", "cloud", 2, False, 1), (2, "en", "rain", 2, False, 2), (2, "en", "study", 2, True, 3), (3, "pt", "chuva", 2, False, 1),
    ], key=repr)
    assert rows(text.language_clouds(df.where("item_id > 5")), "bucket", "lang", "word", "n", "generic", "rank") == [(1, None, "here", 2, False, 1)]


def test_whole_sets_are_compared(spark):
    from folioscope.plans import texts_vectors

    people = [(k, f"P{k}", C.PERSON, None) for k in range(1, 131)]  # more than a dashboard lists
    links = [(900 + j, C.CREATOR, k) for j, most in ((0, 130), (1, 120)) for k in range(1, most + 1)] + [(900, C.IS_PART_OF, 800), (901, C.IS_PART_OF, 801)]
    c = corpus(spark, people + [(k, "x", None, None) for k in (800, 801, 900, 901)], links, records=[900, 901])
    assert rows(texts_vectors.overlap(c), "a", "b", "both", "either", "percent") == [(800, 801, 120, 130, 92)]


def test_all_hubs_are_ranked(spark):
    from folioscope.plans import networks

    people = [(k, f"P{k}", C.PERSON, None) for k in range(4002)]  # more than the shown network has
    links = [(10_000 + 2 * (k // 2) + j, C.CREATOR, k) for k in range(4002) for j in (0, 1)]
    records = sorted({s for s, *_ in links})
    found = networks.entity_hub_rank(corpus(spark, people + [(r, "r", None, None) for r in records], links, records=records)).collect()
    assert sorted((r["rank"], r.item_id, r.score) for r in found) == [(k + 1, k, 5) for k in range(4002)]


def test_connected_top_of_more_edges_than_a_group_takes(spark, monkeypatch):
    def whole(graph, score, top):  # by the definition, all edges at hand
        taken, order = [], sorted(graph, key=lambda u: (-score[u], u))
        while len(taken) < top:
            near = [v for u in taken for v in graph[u] if v not in taken]
            rest = [u for u in order if u not in taken]
            if not near and (not rest or top - len(taken) < 2):
                break
            taken.append(min(near, key=lambda v: (-score[v], v)) if near else rest[0])
        return taken

    monkeypatch.setattr(graphs, "MAX_EDGES", 10)
    rng = random.Random(5)
    for top, sizes in ((5, (12, 9)), (9, (4, 3, 8)), (40, (3, 2))):
        edges, first = set(), 0
        for n in sizes:
            edges |= {(first + rng.randrange(k), first + k) for k in range(1, n) for _ in range(2)}
            first += n
        nodes = sorted({u for e in edges for u in e})
        score = {u: rng.randrange(6) / 8 for u in nodes}
        graph = {u: [b if a == u else a for a, b in edges if u in (a, b)] for u in nodes}
        df = spark.createDataFrame([(a, b, 1) for a, b in edges], "a long, b long, n long")
        found = graphs.connected_top_n(df, spark.createDataFrame(list(score.items()), "node long, rank double"), top)
        assert [r.node for r in found.orderBy("place").collect()] == whole(graph, score, top)
    assert graphs.connected_top_n(df.limit(0), found.selectExpr("node", "0D AS rank"), 3).count() == 0


def test_words_of_a_long_piece_are_not_copied_with_all_of_it(spark, monkeypatch):
    text = "Goma " + "word " * 40_000 + "Lake Chad Goma Goma Chad"  # one piece: 40,000 copies of it were 8 GB
    docs = spark.createDataFrame([(1, text)], "item_id long, text string")
    names = spark.createDataFrame([("Goma", "Goma", 1), ("Chad", "Chad", 1), ("Chad", "Lake Chad", 0)], "place string, name string, weight int")
    for most in (100_000, 0):
        monkeypatch.setattr(geo, "MOST_NAMES", most)
        assert rows(geo.mentions(docs, names, min_mentions=1), "place", "n") == [("Chad", 1), ("Goma", 3)]


def test_orders_are_dealt_by_their_lines(spark, sf, monkeypatch):
    """Tasks that gather statements go by the lines, not by Spark's shuffle partitions, and the statements stay the same."""
    from folioscope.sources import bridge

    want = sorted(tuple(r) for r in bridge.load(spark, sf).links.collect())
    monkeypatch.setattr(bridge, "DEALT", 1000)
    links = bridge.load(spark, sf).links
    assert links.rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 1000)
    assert sorted(tuple(r) for r in links.collect()) == want


def test_joins_with_large_dimensions_are_dealt_by_the_lines(spark, sf, monkeypatch):
    from folioscope.sources import bridge

    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    monkeypatch.setattr(bridge, "DEALT", 1000)
    n = read("lineitem").count()
    join = lambda rows: bridge.met(read("lineitem").select("l_partkey"), "l_partkey", read("part").select("p_partkey"), "p_partkey", rows, n)
    assert join(bridge.FEW + 1).count() == join(1).count() == n
    assert join(bridge.FEW + 1).rdd.getNumPartitions() == -(-n // 1000)
    found = lambda: [sorted(tuple(r) for r in df.collect()) for df in (bridge.load(spark, sf).links, bridge.load(spark, sf).literals)]
    want = found()
    monkeypatch.setattr(bridge, "FEW", 5)
    assert found() == want


def test_lines_are_read_once_for_all_statements(spark, sf):
    from folioscope.sources import bridge

    plan = bridge.load(spark, sf).links._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Relation" in x and "l_partkey" in x]) == 1
