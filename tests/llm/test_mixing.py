import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from folioscope.llm.mixing import apportion, materialise, mix
from tests.llm.cases import TEXTS, docs, empty, rows_of

WORD = r"[^\x20\x09-\x0D]+"


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, Fraction(sum(sizes.values())), set(names)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] >= 3 * sizes[s]}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        target |= {s: Fraction(3 * sizes[s]) for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def check(out, rows, block=16, shards=1):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(WORD, t or ""))
    target, got, source = brute_targets(sizes), defaultdict(int), {}
    for i, t, s in rows:
        source.setdefault(i, s)
    assert len(out) == len(rows)
    for r in out:
        s = source[r.doc_id] if r.doc_id is not None else None
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            assert r.source_size == sizes[s] and abs(r.target - float(target[s])) < 1e-6 * max(1, r.target)
            got[s] += r.taken
    for s in got:
        if s is not None and not any(i is None for i, _, x in rows if x == s):
            assert abs(got[s] - float(target[s])) <= block * shards + 1, (s, got[s], target[s])


def test_cases(spark):
    check(mix(docs(spark)).collect(), TEXTS)
    assert rows_of(mix(empty(spark))) == []


def test_a_table_with_many_shards(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    for shard_docs in (2000, 3):
        out = mix(df, shard_docs=shard_docs)
        check(out.collect(), rows, shards=1 if shard_docs > 3 else 4)
    again = mix(df.repartition(5), shard_docs=3)
    assert rows_of(again) == rows_of(out)


def test_caps(spark):
    rows = [(i, "w " * (2 if i == 0 else 400), "a" if i else "c") for i in range(20)] + [(50, "w " * 3000, "b")]
    check(mix(docs(spark, rows)).collect(), rows)


@pytest.mark.parametrize("votes,seats", [([10, 20, 30, 7], 11), ([1, 1, 1], 2), ([0, 5, 0], 4), ([3, 3], 0), ([1000] + [1] * 30, 12)])
def test_highest_quotients(spark, votes, seats):
    df = spark.createDataFrame(list(enumerate(votes)), "key int, votes int").withColumn("seats", F.lit(seats).cast("long"))
    got = {r.key: r.quota for r in apportion(df, None, "key", "votes", "seats").collect()}
    want = dict.fromkeys(range(len(votes)), 0)
    for _ in range(seats):
        k = max((Fraction(v, 2 * want[i] + 1), -i) for i, v in enumerate(votes))
        want[-k[1]] += 1
    assert got == want


def test_the_mix_itself(spark):
    rows = TEXTS + [(60, "only few words here", "b")]
    df = docs(spark, rows)
    plan = defaultdict(int)
    for r in mix(df).collect():
        plan[r.doc_id] += r.taken
    got = defaultdict(int)
    made = materialise(df)
    assert made.columns == df.columns
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t or "")
    for r in made.collect():
        got[r.doc_id] += len(re.findall(WORD, r.text))
        assert any(r.text in t for t in texts[r.doc_id])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in plan.items() if v}
