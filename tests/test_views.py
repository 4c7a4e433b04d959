"""Context, narrowed views, releases and dashboards on small rows of their own."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import columns as C
from folioscope.operators import articles, context, dist, geo, narrow
from folioscope.plans import dashboards, publish, release, shapes
from folioscope.streaming import windows
from tests.test_operators import corpus, rows


def test_contexts(spark):
    items = [(1, "a", None, 2001), (2, "P", C.PROJECT, None), (3, "Q", C.PROJECT, None), (4, "set", None, None)]
    c = corpus(spark, items, [(1, C.IS_PART_OF, 3), (1, C.IS_PART_OF, 4), (1, C.IS_PART_OF, 2)], [(1, "bibo:abstract", "b"), (1, C.ABSTRACT, "x"), (1, C.ABSTRACT, "y")])
    got = {r["item_id"]: r for r in context.item_contexts(c).collect()}
    assert [tuple(p) for p in got[1]["parents"]] == [(3, "Q"), (2, "P")]
    assert got[1]["abstract"] == "x" and got[2]["abstract"] == "" and got[2]["parents"] == []


def test_first_creator_skips_the_untitled(spark):
    c = corpus(spark, [(1, "a", None, None), (2, "", None, None), (3, "C", None, None), (4, "D", None, None)], [(1, C.CREATOR, 2), (1, "marcrel:aut", 3), (1, C.CREATOR, 4)])
    assert rows(context.first_creator(c)) == [(1, "C")]


def test_featured_needs_what_is_given(spark):
    c = corpus(spark, [(1, "a", None, None), (2, "b", None, None), (9, "p", None, None)], [(1, "marcrel:prn", 9)], [(1, "dcterms:identifier", "x-1"), (2, "dcterms:identifier", "x-2")])
    assert rows(context.featured(c, "x-")) == [(1,), (2,)]
    assert rows(context.featured(c, "x-", 9)) == [(1,)]


def test_synthetic_types_replace_real_ones(spark):
    c = corpus(spark, [(1, "a", None, None), (2, "b", None, None), (5, "Text", None, None)], [(1, C.TYPE, 5), (2, C.TYPE, 5)], records=[1, 2])
    made = context.with_types(c, spark.createDataFrame([(1, "Video")], "item_id long, title string"))
    assert rows(dist.dimension(made, "types"), "title", "n") == [("Text", 1), ("Video", 1)]
    assert made.items.where("item_id < 0").count() == 1


def test_folding_starts_beyond_most(spark):
    nodes = spark.createDataFrame([(k, g) for k, g in enumerate([7, 7, 7, 3, 3, 9])], "node long, community long")
    assert rows(narrow.folded(nodes, 3), "community", "merged") == [(3, False)] * 2 + [(7, False)] * 3 + [(9, False)]
    assert rows(narrow.folded(nodes, 2), "community", "merged") == [(0, False)] * 3 + [(1, True)] * 3


def test_dominant_section_is_a_strict_majority(spark):
    links = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (1, 11), (2, 11), (4, 12)], "src long, dst long")
    sections = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "src long, section string")
    assert rows(narrow.dominant_sections(links, sections)) == [(10, 0), (11, -2), (12, -1)]


def test_labels_go_with_their_size(spark):
    groups = spark.createDataFrame([(1, 5), (2, 6)], "id long, size long")
    labels = spark.createDataFrame([(1, 5, " one "), (2, 7, "two")], "id long, size long, label string")
    assert rows(narrow.labelled(groups, labels)) == [(1, 5, "one"), (2, 6, None)]


def test_an_item_in_two_corpora_is_an_error(spark):
    made = lambda *r: spark.createDataFrame([(i, c, True, False, False) for i, c in r], "item_id long, corpus string, is_public boolean, low_signal boolean, truncated boolean")
    assert rows(articles.one_corpus_counts(made((1, "a"), (2, "a")))) == [("a", 2, 2, 0, 0)]
    with pytest.raises(Exception, match="in two corpora: 1"):
        articles.one_corpus_counts(made((1, "a"), (1, "b"))).collect()


def test_shared_texts(spark):
    unit = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [0.0, 2.0]), (5, [-1.0, 0.5]), (6, [-0.5, -1.0])], "item_id long, vector array<double>")
    hashes = spark.createDataFrame([(5, "x"), (6, "y"), (7, "x")], "item_id long, hash string")
    assert rows(articles.shared_texts(unit, hashes)) == [(1,), (2,), (3,), (4,), (5,), (7,)]


def test_small_content_maps_are_empty(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 0.5, 0.5)], "item_id long, x double, y double")
    near = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2)], "src long, dst long, score double, rank long")
    public = points.where("item_id != 2")
    shown, kept = articles.content_map(points, near, public, least=2)
    assert rows(shown, "item_id") == [(1,), (3,)] and rows(kept) == [(1, 3, 1)]
    assert articles.content_map(points, near, public, least=3)[0].count() == 0


def test_corpora_are_laid_out_apart(spark):
    made = spark.createDataFrame([(i, "a" if i < 4 else "b", [float(i), float(i * i % 5), 1.0]) for i in range(6)], "item_id long, corpus string, vector array<double>")
    assert rows(articles.corpus_layouts(made, "corpus"), "corpus", "item_id") == [("a", i) for i in range(4)]


def test_releases_fail_closed(spark, tmp_path):
    made = spark.createDataFrame([(1, [1.0, 0.5]), (2, [0.25, 1.0])], "item_id long, vector array<double>")
    at = str(tmp_path / "r")
    release.write_release(made, at, model="m", revision="1")
    assert rows(release.read_release(spark, at, model="m"), "item_id") == [(1,), (2,)]
    with pytest.raises(ValueError, match="model"):
        release.read_release(spark, at, model="other")
    made.limit(1).withColumn("vector", F.col("vector").cast("array<float>")).write.mode("append").parquet(f"{at}/vectors")
    with pytest.raises(ValueError, match="checksum"):
        release.read_release(spark, at)


def test_shapes_are_held(spark, tmp_path):
    store = publish.Store(tmp_path)
    good = spark.createDataFrame([(1, 2, 3)], "a long, b long, n long")
    assert store.publish({"edges/people.json": good}, check=shapes.check)
    for bad in (good.withColumn("n", F.lit(None).cast("long")), good.withColumn("b", F.col("a"))):
        with pytest.raises(ValueError):
            store.publish({"edges/people.json": bad}, check=shapes.check)
    assert store.read("edges/people.json") == [{"a": 1, "b": 2, "n": 3}]


def test_a_withdrawal_waits_for_less(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    edits = spark.createDataFrame([(1, at(0), False), (1, at(200), False), (1, at(900), True), (2, at(0), True)], "site_id long, ts timestamp, withdrawn boolean")
    start = rows(edits.select(F.unix_micros(F.min("ts"))))[0][0]
    got = [(s, (due - start) // 1_000_000, n, w) for s, due, n, w in rows(windows.settled(edits))]
    assert got == [(1, 500, 2, False), (1, 960, 1, True), (2, 60, 1, True)]


ONLY = ("timeline", "languages", "roles")


@pytest.fixture(scope="module")
def made(spark):
    items = [(1, "a", None, 2001), (2, "b", None, 2002), (3, "P", C.PROJECT, None), (4, "S", C.GROUP, None), (5, "X", C.PERSON, None), (6, "O", C.ORGANISATION, None), (7, "L", C.LOCATION, None), (8, "J", C.JOURNAL, None), (9, "en", None, None)]
    links = [(3, C.IS_PART_OF, 4), (1, C.CREATOR, 5), (2, C.CREATOR, 5), (1, C.FUNDER, 6)]
    links += [(i, t, d) for i in (1, 2) for t, d in ((C.IS_PART_OF, 3), (C.LANGUAGE, 9), (C.SPATIAL, 7), (C.IS_PART_OF, 8))]
    return corpus(spark, items, links, records=[1, 2], memberships=[(50, 1)])


@pytest.mark.parametrize(
    "family, entity, years", [("sections", 4, 2), ("projects", 3, 2), ("people", 5, 2), ("organisations", 6, 1), ("places", 7, 2), ("journals", 8, 2), ("languages", 9, 2), ("collections", 50, 1)]
)
def test_families(spark, made, family, entity, years):
    frames = dashboards.charts(made, family, geo.country_index(made.geo, geo.square_outlines(spark)), ONLY)
    assert set(frames) == set(ONLY) - set(dashboards.FAMILIES[family].without)
    assert rows(frames["timeline"].groupBy("entity").count()) == [(entity, years)]


def test_every_chart_has_entities(spark, made):
    countries = spark.createDataFrame([(7, "C")], "item_id long, country string")
    for name, df in dashboards.charts(made, "sections", countries).items():
        assert "entity" in df.columns, name


def test_dashboards_are_written(spark, made, tmp_path):
    countries = spark.createDataFrame([(7, "C")], "item_id long, country string")
    dashboards.write(made, countries, str(tmp_path), ("projects",), ONLY)
    got = spark.read.parquet(str(tmp_path / "projects"))
    assert rows(got, "entity", "chart", "rows") == [(3, "languages", 1), (3, "roles", 1), (3, "timeline", 2)]
    assert rows(got.where("chart = 'roles'"), "body") == [('[{"role":"creator","n":2}]',)]
    pages = dashboards.bundled({"timeline": dashboards.charts(made, "projects", countries, ONLY)["timeline"]}, 1)
    assert rows(pages.where("entity = 3"), "page", "rows") == [(0, 1), (1, 1)]
