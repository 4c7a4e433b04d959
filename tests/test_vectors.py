"""Neighbours by a coarse quantiser against the exact ones."""

import os

import numpy as np
import pytest

from folioscope.operators import vectors


def table(spark, sf):
    from pyspark.sql import functions as F

    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def by_source(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.src, {})[r.dst] = r.score
    return found


def recall(near, exact):
    """Share of the exact neighbours found; one as near as the twelfth counts as it."""
    hit = total = 0
    for src, want in exact.items():
        least, got = min(want.values()), near.get(src, {})
        hit += min(len(want), sum(s >= least for s in got.values()))
        total += len(want)
    return hit / total


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_of_candidates(spark, size):
    sf = f"/root/testdata/{size}"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    rows = table(spark, sf).persist()
    exact, near = by_source(vectors.similar_items(rows)), by_source(vectors.near_items(rows))
    share = recall(near, exact)
    print(f"recall@12 at {size}: {share:.4f}")
    assert share >= 0.9
    for src, got in near.items():  # scores are exact cosines
        assert all(exact[src][d] == s for d, s in got.items() if d in exact[src])


def test_all_lists_give_the_exact_answer(spark):
    rng = np.random.default_rng(3)
    points = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(180)] + [(500 + k, [1.0] * 8) for k in range(30)]  # a group of equal vectors
    df = spark.createDataFrame(points, "item_id long, vector array<double>")
    same = lambda f: sorted(map(tuple, f.collect()))
    assert same(vectors.near_items(df, lists=5, homes=1, probes=5, block=16)) == same(vectors.similar_items(df))
    assert vectors.near_items(df.limit(0)).collect() == []


def test_copies_of_a_row_do_not_grow_with_the_table():
    at = [vectors.block_count(n, 64, 4096, 36) for n in (2_000, 50_000, 300_000, 720_000)]
    assert at == [1, 6, 6, 6]


def test_neighbours_of_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(1, 4, (60, 3)).astype(float)  # many equal ones, many ties
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "item_id long, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = [tuple(x) for x in vectors.normalised(df).orderBy("item_id").select("hash").collect()]
    want = []
    for a in range(60):
        first = {}
        for b in range(60):
            if rows[a] != rows[b]:
                first.setdefault(rows[b], (-round(float(unit[a] @ unit[b]), 6), b))
        want += [(a, b, -s, k) for k, (s, b) in enumerate(sorted(first.values())[:5], 1)]
    for block in (7, 4096):
        got = [tuple(r) for r in vectors.similar_items(df, top=5, block=block).select("src", "dst", "score", "rank").collect()]
        assert sorted(got) == [(a, b, pytest.approx(s, abs=1e-6), k) for a, b, s, k in sorted(want)]


def test_passages_are_matched_by_blocks(spark, monkeypatch):
    from folioscope.operators import articles

    def no_rows(*_):
        raise AssertionError("pairs of passages became rows")

    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, (50, 3)) + 0.5
    df = spark.createDataFrame([(k % 2, k, x.tolist(), ["w"]) for k, x in enumerate(v)], "item_id long, passage long, vector array<double>, terms array<string>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = min((-round(float(unit[a] @ unit[b]), 4), a, b) for a in range(0, 50, 2) for b in range(1, 50, 2))
    monkeypatch.setattr(vectors, "BLOCK", 8)
    monkeypatch.setattr(articles, "_dot", no_rows)
    [r] = articles.passage_reasons(spark.createDataFrame([(0, 1)], "src long, dst long"), df).collect()
    assert (-r.passage_score, r.source_passage, r.neighbour_passage, r.shared_terms) == (pytest.approx(want[0]), *want[1:], ["w"])
