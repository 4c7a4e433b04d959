"""Every query with oracle SQL, Spark against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from folioscope import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow for a unit test; the driver compares them.
HEAVY = {"kg_slider", "kg_stats", "kg_edge_stats", "kg_nodes"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def kept_corpus(spark, sf):
    """The corpus is made once for all tests; queries make it anew."""
    from dataclasses import fields

    from folioscope.corpus import Corpus
    from folioscope.plans import registry

    made = registry.bridge.load(spark, sf)
    made = Corpus(**{f.name: getattr(made, f.name).persist() for f in fields(made)})
    before, registry.bridge.load = registry.bridge.load, lambda *_: made
    yield
    registry.bridge.load = before


def normal(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(plans.SQL) - HEAVY))
def test_against_duckdb(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    want = duck.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), want.columns)


def partition(rows):
    """Communities are numbered from 0 by size, the largest first."""
    sizes = Counter(r.community for r in rows if r.community >= 0)
    assert sorted(sizes) == list(range(len(sizes)))
    assert [sizes[k] for k in sorted(sizes)] == sorted(sizes.values(), reverse=True)


def unique(rows, *columns):
    assert len({tuple(r[c] for c in columns) for r in rows}) == len(rows)


def whole(rows, *columns):
    assert all(r[c] is not None and r[c] == r[c] for r in rows for c in columns)


def check_passages(rows):
    unique(rows, "item_id", "idx")
    assert all(r.words == len(r.text.split(" ")) and r.words > 0 for r in rows if "text" in r)


def check_keywords(rows):
    for r in rows:
        assert 1 <= r["rank"] <= 8 and r.score >= 0
    for a in rows:
        for b in rows:
            if a is not b and all(a[c] == b[c] for c in a.__fields__ if c not in ("term", "score", "rank")):
                assert a.term not in b.term, (a, b)


def check_points(*axes):
    def check(rows):
        unique(rows, "item_id") if "item_id" in rows[0] else None
        whole(rows, *axes)

    return check


def check_communities(rows):
    unique(rows, "node")
    partition(rows)


def check_places(rows):
    unique(rows, "node")
    assert sorted(r.place for r in rows) == list(range(1, len(rows) + 1))


def check_layout(rows):
    unique(rows, "node")
    assert all(abs(r.lon) <= 140 and abs(r.lat) <= 77.7 for r in rows)
    assert max(max(abs(r.lon) / 140, abs(r.lat) / 77.6) for r in rows) > 0.99


def check_shown(rows):
    unique(rows, "node")
    whole(rows, "name", "community", "rank")
    assert len(rows) <= 120
    by = sorted(rows, key=lambda r: r.place)
    assert all(a["rank"] >= b["rank"] for a, b in zip(by, by[1:]))


def check_links(rows):
    unique(rows, "a", "b")
    assert all(r.a < r.b and r.n >= 1 and r.relation in ("coauthor", "coeditor", "mixed") for r in rows)


def check_entities(rows):
    unique(rows, "node")
    partition(rows)
    assert all(r.score == 3 * r.degree + r.n and abs(r.lon) <= 140 and r.section != 0 for r in rows)


def check_centres(rows):
    unique(rows, "center", "node")
    assert all(r.center != r.node for r in rows)
    sizes = Counter((r.center, r.community) for r in rows)
    assert min(sizes.values()) >= 2
    assert all((c, k - 1) in sizes and sizes[c, k - 1] >= n for (c, k), n in sizes.items() if k)


def check_neighbours(rows):
    unique(rows, "src", "dst")
    by = {}
    for r in rows:
        by.setdefault(r.src, []).append(r)
    for near in by.values():
        near.sort(key=lambda r: r.rank)
        assert [r.rank for r in near] == list(range(1, len(near) + 1)) and len(near) <= 12
        assert all((-a.score, a.dst) < (-b.score, b.dst) for a, b in zip(near, near[1:]))


#: What holds for the rows of each query that SQL can't say.
CHECKS = {
    "passages": check_passages, "passages_sql": check_passages, "knn_near": check_neighbours, "keywords": check_keywords, "pca_map": check_points("x", "y"), "corpus_layouts": check_points("x", "y"), "article_points": check_points("x", "y"),
    "kmeans": lambda rows: unique(rows, "item_id"), "louvain": check_communities, "louvain_multilevel": check_communities, "label_propagation": check_communities,
    "connected_top_n": check_places, "force_layout": check_layout, "kg_communities": check_centres, "collaboration_network": check_shown, "coauthor_network": check_shown,
    "coauthor_network_links": check_links, "entity_network": check_entities,
}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_without_sql(spark, sf, name):
    rows = plans.QUERIES[name](spark, sf).collect()
    assert rows
    CHECKS[name](rows)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(entry.__file__)
