import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from folioscope.llm import simhash
from folioscope.llm.exact_dedup import exact_dedup
from folioscope.llm.line_dedup import LineRuns, line_dedup
from tests.llm.cases import TEXTS, docs, empty, rows_of

WS = "[ \t\n\x0b\x0c\r]"


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(WS, "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t, _ in rows:
        norm = re.sub(WS, "", t or "")
        g = sorted(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))
        keep = g[0][2]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_cases(spark):
    assert rows_of(exact_dedup(docs(spark), digest_all=True)) == brute_exact(TEXTS)
    assert rows_of(exact_dedup(empty(spark))) == []


def test_exact_dedup_hashes_only_what_earlier_levels_leave(spark):
    rows = [(1, "ab cd", None), (2, "abcd", None), (3, "abce", None), (4, "something else", None)]
    got = {r[0]: r for r in rows_of(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")))}
    assert got[1][1:4] == (1, 2, True) and got[2][1:4] == (1, 2, False)
    assert got[4][4] is None and got[3][2] == 1


def test_exact_dedup_deals_out_singles_and_copies(spark):
    """Without adaptive execution: neither the rows that are alone nor a third of all rows that are copies meet in one task."""
    from pyspark.sql import functions as F

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one copy")).when(F.col("id") % 30 == 1, F.lit("x").cast("string")).otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        out = exact_dedup(rows.repartition(8), digest_all=True)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        got = out.groupBy("group_size").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) <= 3 * sum(sizes) / len(sizes), sizes
    assert {tuple(r) for r in got} == {(1000, 1000), (100, 100), (1, 1900)}


def test_exact_dedup_with_a_full_bitmap(spark):
    """More pairs than the bitmap tells apart: more rows are hashed, the answer is the same."""
    assert rows_of(exact_dedup(docs(spark), digest_all=True, bits=64)) == brute_exact(TEXTS)


def brute_lines(rows, min_docs):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_cases(spark):
    rows = TEXTS + [(100 + i, f"Menu\nline {i}\n menu\t\n\nfooter {i % 2}", "a") for i in range(12)]
    df = docs(spark, rows)
    halves = [df.where("coalesce(doc_id, 0) % 2 = 0"), df.where("coalesce(doc_id, 0) % 2 = 1")]
    for min_docs in (2, 10):
        assert rows_of(line_dedup(halves, min_docs=min_docs)) == brute_lines(rows, min_docs)
    assert rows_of(line_dedup([empty(spark)])) == []


def test_line_runs_are_sorted_and_compacted(spark):
    store = LineRuns(spark, fanout=2)
    for _ in range(3):
        store.add(spark.createDataFrame([("b",), ("a",), ("a",)], "key string"))
    assert [len(level) for level in store.levels] == [1, 1]
    assert rows_of(store.frequent(6)) == [("a",)]
    for path in store.runs():
        for part in spark.read.parquet(path).rdd.glom().collect():
            assert [r.key for r in part] == sorted(r.key for r in part)


def test_line_runs_settle_and_merge(spark):
    """Four batches from one table: two levels of merges, by joins that neither move nor sort a run."""
    store = LineRuns(spark, min_docs=3, buckets=5)
    plans, merged = [], store.merged
    store.merged = lambda runs: plans.append(df := merged(runs)) or df
    batches = [["a", "b"], ["a"] * 3 + ["c"], ["a", "b", "d"], ["a", "b"]]
    added = []
    for batch in batches:
        store.add(spark.createDataFrame([(k,) for k in batch], "key string"))
        added.append([len(level) for level in store.levels])
    assert added == [[1], [0, 1], [1, 1], [0, 0, 1]] and store.merges == 3
    # a is settled by the second batch (1 + 3) and counted no more
    assert rows_of(store.totals()) == [("a", 4), ("b", 3), ("c", 1), ("d", 1)]
    assert rows_of(store.frequent(3)) == [("a",), ("b",)]
    with store._cut_alike():
        runs = []
        for batch in (["a", "b"], ["b", "c"]):
            store._write(spark.createDataFrame([(k, 1) for k in batch], "key string, n_docs long"), 0)
            runs.append(store.levels[0][-1])
        plan = merged(runs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, plan


def test_line_dedup_takes_four_batches_of_one_file(spark, sf, monkeypatch):
    made = []
    add = LineRuns.add
    monkeypatch.setattr(LineRuns, "add", lambda self, keys: made.append(self) or add(self, keys))
    line_dedup(spark.read.parquet(f"{sf}/documents.parquet"))
    assert len(made) == 4 and made[0].merges == 3 and len(made[0].runs()) == 1


def test_line_dedup_of_a_hot_line(spark):
    """One line in every document; keys in no more than the floor go by the merge join."""
    rows = [(i, f"every\nsome {i % 3}\nten {i // 10}\nown {i}\nevery", "a") for i in range(60)]
    assert rows_of(line_dedup(docs(spark, rows))) == brute_lines(rows, 10)


def test_line_dedup_of_a_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in df.collect()]
    assert rows_of(line_dedup(df, min_docs=3)) == brute_lines(rows, 3)


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: [(id, fingerprint)]"""
    rest, out = list(range(len(fps))), []
    while rest:
        todo, group = [rest.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = [y for y in rest if (fps[x][1] ^ fps[y][1]).bit_count() <= 3]
            rest = [y for y in rest if y not in set(near)]
            todo += near
        ids = [fps[x][0] for x in group if fps[x][0] is not None]
        out += [(fps[x][0], f"{fps[x][1]:016x}", min(ids, default=None)) for x in group]
    return sorted(out, key=repr)


def test_simhash_cases(spark):
    want = brute_components([(i, brute_fingerprint(t)) for i, t, _ in TEXTS])
    assert rows_of(simhash.simhash_components(docs(spark))) == want
    assert rows_of(simhash.simhash_components(empty(spark))) == []


def test_simhash_of_a_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()])
    assert rows_of(simhash.simhash_components(df)) == want


def test_anchors_cover_every_link():
    rng = random.Random(5)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        fps = np.array([x, y], np.uint64).view(np.int64)
        index, cells, probe = simhash.anchors(fps)
        homes = {c for i, c, p in zip(index, cells, probe) if i == 0 and not p}
        assert homes & {c for i, c, p in zip(index, cells, probe) if i == 1 and p}


def test_chains_and_heavy_anchors(spark):
    """A chain of 40 near copies and a ball around one fingerprint, with anchors cut into blocks."""
    rng = random.Random(6)
    x = rng.getrandbits(64)
    fps = {x}
    for _ in range(40):
        for b in rng.sample(range(64), 2):
            x ^= 1 << b
        fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    for limit in (4096, 4):
        found = {r.node: r.root for r in simhash.components(simhash.links(df, limit)).collect()}
        got = defaultdict(set)
        for (f,) in signed:
            got[found.get(f, f)].add(f)
        want = defaultdict(set)
        for i, _, c in brute_components([(int(np.int64(f[0])), int(np.int64(f[0]).view(np.uint64))) for f in signed]):
            want[c].add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
