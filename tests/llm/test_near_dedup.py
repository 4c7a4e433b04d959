import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import near_dedup as N
from tests.llm.cases import TEXTS, docs, empty, rows_of


def shingles(text, words=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or ({" ".join(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def splitmix(h, k):
    if not k:
        return h
    m = (1 << 64) - 1
    z = (h + k * 0x9E3779B97F4A7C15) & m
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m
    return z ^ z >> 31


def brute_long(text, prints=3):
    h = {xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text)}
    return tuple(sum(1 << b for b in range(64) if 2 * sum(splitmix(x, k) >> b & 1 for x in h) > len(h)) for k in range(prints))


def brute_groups(rows, similarity=0.8):
    """{id: smallest id reachable} by exact similarity of all pairs; no shingles are alike only among themselves."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x == y or x and y and jaccard(x, y) >= similarity:
                parent[top(a)] = top(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[top(k)].append(i)
    return {i: min(low[top(k)]) for k, (i, _) in enumerate(sets)}


def edited(words, rng, share):
    """A copy with about ``share`` of the words changed, one here and one there."""
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


def test_fingerprints_are_those_of_brute_force():
    for text in ("", "One", "one two three four five", "A b C d e f g h", TEXTS[0][1], TEXTS[7][1], "word " * 3000):
        assert tuple(int(x) for x in N.long_fingerprint(text.encode())) == brute_long(text)


def test_cases(spark):
    rows = [(i if i is not None else 1000 + k, t, s) for k, (i, t, s) in enumerate(TEXTS)]
    want = brute_groups([r[:2] for r in rows])
    assert rows_of(N.near_components(docs(spark, rows))) == sorted(((r[0], want[r[0]]) for r in rows), key=repr)
    assert rows_of(N.near_components(empty(spark))) == []
    clash = docs(spark, rows).withColumns({c: F.lit("x") for c in ("node", "f0", "cell", "part", "side", "component_id")})
    assert rows_of(N.near_components(clash)) == sorted(((r[0], want[r[0]]) for r in rows), key=repr)


def test_anchors_of_a_block():
    rng = random.Random(3)
    met = 0
    for _ in range(2000):
        x = rng.getrandbits(N.BLOCK)
        y = x
        for b in rng.sample(range(N.BLOCK), rng.randint(0, 2)):
            y ^= 1 << b
        index, words = N.anchors(np.array([x, y], np.int64))
        assert all((int(w) ^ (x, y)[i]).bit_count() <= 2 for i, w in zip(index, words))
        met += bool({int(w) for i, w in zip(index, words) if i == 0} & {int(w) for i, w in zip(index, words) if i == 1})
    assert met / 2000 > 0.92  # 15 of 16 by the code


def test_blocks_take_all_their_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, size=(50, 3)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, size=(50, 3)).astype(np.uint64)
    for block in range(8):
        want = [(sum(int(x) << 64 * k for k, x in enumerate(row)) >> 23 * block) & ((1 << 23) - 1) for row in fps]
        assert N._bits_of(fps, block).tolist() == want


def test_near_copies_are_found_and_others_left(spark):
    """Recall against exact Jaccard over five words, with anchors whole and cut into blocks."""
    rng = random.Random(4)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randint(80, 300))] for _ in range(120)]
    rows, copies = [(k, " ".join(w)) for k, w in enumerate(base)], []
    for k, w in enumerate(base):
        copy = " ".join(edited(w, rng, 0.012))
        copies.append((1000 + k, copy))
    heads = [(2000 + k, " ".join(w[: len(w) // 2] + [f"x{rng.random()}" for _ in w])) for k, w in enumerate(base[:60])]
    table = spark.createDataFrame(rows + copies + heads, "doc_id long, text string")
    coarse = brute_groups(rows + copies + heads)
    near = [(a[0], b[0]) for a, b in zip(rows, copies) if jaccard(shingles(a[1]), shingles(b[1])) >= 0.8]
    assert len(near) > 90
    for limit in (4096, 3):
        got = {r.doc_id: r.component_id for r in N.near_components(table, cell_limit=limit).collect()}
        assert all(coarse[i] == coarse[c] for i, c in got.items())  # no link that isn't one
        assert sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
        assert all(got[i] == i for i, _ in heads)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    rows = [(k, " ".join(edited(base, rng, 0.003))) for k in range(600)] + [(5000 + k, " ".join(base)) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (4096, 50):
        got = N.near_components(table, cell_limit=limit).groupBy("component_id").count().collect()
        assert max(r["count"] for r in got) >= 1190


def test_candidates_that_are_too_different_do_not_link(spark):
    """Fingerprints within the bits, sets just below the similarity: no links, whichever pairs are in the forest; true links across what it parts are found."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]

    def spread(k, gaps):  # k single words changed far apart take 5 shingles each
        w = list(base)
        for g in gaps[:k]:
            w[10 + 12 * g] = f"y{rng.random()}"
        return w

    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        rows.append((k, " ".join(spread(rng.choice([3, 6, 7, 8]), rng.sample(range(23), 8)))))
    want = brute_groups(rows)
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0]]
    sims = [jaccard(shingles(a[1]), shingles(b[1])) for a, b in pairs]
    assert any(0.7 < s < 0.8 for s in sims) and any(s >= 0.8 for s in sims)
    got = {r.doc_id: r.component_id for r in N.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] == want[c] for i, c in got.items())
    linked = [(a[0], b[0]) for (a, b), s in zip(pairs, sims) if s >= 0.8]
    assert sum(got[a] == got[b] for a, b in linked) >= 0.9 * len(linked)


def test_forest_is_the_least():
    rng = np.random.default_rng(7)
    for _ in range(50):
        n, m = int(rng.integers(2, 30)), int(rng.integers(1, 120))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        a, b = a[a != b], b[a != b]
        w = rng.integers(0, 9, len(a))
        stay = N.forest(a, b, w)
        label = list(range(n))

        def top(x):
            while label[x] != x:
                x = label[x]
            return x

        best = []
        for k in sorted(range(len(a)), key=lambda k: (w[k], k)):
            if top(a[k]) != top(b[k]):
                label[top(a[k])] = top(b[k])
                best.append(k)
        assert sorted(stay) == sorted(best)


def test_ids_that_repeat_and_ids_of_other_types(spark):
    """An id's several texts are told apart; ids may be of any type with an order."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    near = " ".join(base[:100] + ["other"] + base[101:])
    rows = [("b", " ".join(base)), ("a", near), ("b", "something else entirely in here"), ("c", "something else entirely in here")]
    got = rows_of(N.near_components(spark.createDataFrame(rows, "doc_id string, text string")))
    assert got == [("a", "a"), ("b", "a"), ("b", "b"), ("c", "b")]


def test_a_pair_is_a_candidate_in_one_cell_only():
    """What leaves the cells is all pairs that meet, each once, in however many cells they meet."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    fps = np.repeat(rng.integers(0, 1 << 63, (3, 3)).astype(np.uint64), 40, axis=0)
    for row in fps:
        for bit in rng.choice(192, 7, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    index, cells = map(np.concatenate, zip(*((i, w | b << N.BLOCK) for b in range(8) for i, w in [N.anchors(N._bits_of(fps, b))])))
    order = np.argsort(cells, kind="stable")
    index, cells = index[order], cells[order]
    zero = np.zeros(len(index), np.int64)
    columns = [cells, zero, zero, index, index, *fps[index].view(np.int64).T]
    batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["cell", "part", "side", "node", "part_of", "f0", "f1", "f2"])
    got = [(r["u"], r["v"]) for out in N._compare(3, 33, True, range(8))(iter([batch])) for r in out.to_pylist()]
    members = defaultdict(set)
    for i, c in zip(index.tolist(), cells.tolist()):
        members[c].add(i)
    met = [(a, b) for m in members.values() for a in m for b in m if a < b and np.bitwise_count(fps[a] ^ fps[b]).sum() <= 33]
    assert len(met) > 2 * len(set(met))
    assert sorted(got) == sorted(set(met))
