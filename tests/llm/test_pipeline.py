import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm.quality import content_features, meta_features, train
from tests.llm.cases import rows_of
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_mixing import WORD, brute_targets
from tests.llm.test_near_dedup import brute_groups, jaccard, shingles
from tests.llm.test_tokens import brute as brute_tokens


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5

    scored = stages["quality classifier"](spark, docs, sf)
    assert scored.columns == columns
    model = train(docs, labels)
    want = set()
    for r in docs.collect():
        p = model(np.array([content_features(r.text.encode())]), np.array([meta_features(r.lang, r.source, r.n_chars)]))
        if p[0][0] >= 0.5:
            want.add(r.doc_id)
    kept = scored.collect()
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)

    one = stages["simhash near-dedup"](spark, scored, sf)
    assert one.columns == columns
    groups = brute_groups([(r.doc_id, r.text) for r in kept])
    stay, sets = {r.doc_id for r in one.collect()}, {r.doc_id: shingles(r.text) for r in kept}
    # Whatever goes is in a group by all pairs of fingerprints, and the first of a group stays.
    assert stay <= sets.keys() and set(groups.values()) <= stay
    order = sorted(sets)
    copies = [b for k, b in enumerate(order) if any(sets[a] == sets[b] for a in order[:k])]
    near = [b for k, b in enumerate(order) if any(0.8 <= jaccard(sets[a], sets[b]) < 1 for a in order[:k])]
    assert copies and not stay & set(copies)
    # Few in this table; test_near_dedup.py has more of them.
    assert len(stay & set(near)) <= max(1, 0.2 * len(near))

    clean = stages["benchmark decontamination"](spark, one, sf)
    assert clean.columns == columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = one.collect()
    hit = {h[0] for h in brute_hits([(r.doc_id, r.text) for r in rows], bench) if h[5]}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - hit

    mixed = stages["mixing"](spark, clean, sf)
    assert mixed.columns == columns
    sizes, got = defaultdict(int), defaultdict(int)
    for r in clean.collect():
        sizes[r.source] += len(re.findall(WORD, r.text))
    made = mixed.collect()
    for r in made:
        got[r.source] += len(re.findall(WORD, r.text))
        assert r.n_chars == len(r.text)
    for s, target in brute_targets(sizes).items():
        assert abs(got[s] - float(target)) <= 17

    ids = stages["token-id output"](spark, mixed, sf)
    assert rows_of(ids) == brute_tokens([(r.doc_id, r.text, None) for r in made])


def test_rows_without_ids_are_documents_too(spark, sf):
    long = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(None, long[0], "en", "a", 1), (None, long[1], "en", "a", 1), (None, long[1], "en", "a", 1), (5, long[2], "en", "a", 1), (None, long[2], None, None, None), (6, long[3], "en", "a", 1), (6, long[3], "en", "a", 1), (7, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["simhash near-dedup"](spark, docs, sf)
    assert sorted(map(str, ((r.doc_id, r.text) for r in one.collect()))) == sorted(map(str, [(None, long[0]), (None, long[1]), (5, long[2]), (6, long[3]), (7, None)]))
    assert stages["benchmark decontamination"](spark, one, sf).count() == 5
    mixed = stages["mixing"](spark, one, sf)
    assert mixed.columns == docs.columns and stages["token-id output"](spark, mixed, sf).count() == mixed.count()
    assert stages["quality classifier"](spark, docs.limit(0), sf).count() == 0


def test_stages_take_odd_tables(spark, sf):
    """Columns of clashing names, null and empty and very long texts, ties and repeats, and no rows at all, through all stages."""
    words = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    rows = [(1, words[0], "en", "a", 1), (2, words[1], "en", None, 1), (2, words[1], "en", None, 1), (2, words[2], "de", "b", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "y" * 300_000, "en", "a", 1), (6, "long word " * 40_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("key", "key_", "hash", "KEY", "node", "row_hash", "nth", "full_passes", "_key", "_hash", "_nth", "_full_passes", "id", "size", "target", "component_id", "n_hit", "quality_score", "accepted")
    extra = [c for c in extra if c != "KEY"]
    odd = docs.withColumns({c: F.lit(f"own {c}") for c in extra})
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality classifier":
                assert stage(spark, table, sf).columns == odd.columns
                continue
            out = stage(spark, table, sf)
            if name == "token-id output":
                assert out.count() == table.count()
                continue
            assert out.columns == odd.columns, name
            for r in out.collect():
                assert all(r[c] == f"own {c}" for c in extra), name
            table = spark.createDataFrame(out.collect(), out.schema) if out.count() else table
