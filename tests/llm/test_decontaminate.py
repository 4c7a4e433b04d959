import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import decontaminate as module
from folioscope.llm.decontaminate import clean, decontaminate, load_items, scan
from tests.llm.cases import TEXTS, docs, empty, rows_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ITEMS = [
    (1, "quick brown fox JUMPS over the lazy dog, near the old river"), (10, "naïve"), (9, "word " * 12), (2, None), (3, "..."), (11, "NAÏVE?"),
    (4, "the old river bank today"), (5, "no such thing"), (9, "word " * 12), (12, "Füße café"),
]


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, n=10):
    out = []
    wins = [(i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}) for i, t in items if (w := words(t))]
    for doc, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for i, windows in wins:
            for length in {len(x) for x in windows}:
                for k in range(len(w) - length + 1):
                    if tuple(w[k : k + length]) in windows:
                        hit |= set(range(k, k + length))
                        found.add(str(i))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def test_cases(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate(docs(spark), items)
    assert rows_of(out.drop("spans")) == brute(TEXTS, ITEMS)
    for r in out.join(docs(spark).select("doc_id", "text"), "doc_id").collect():
        assert sum(len(words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit
    assert rows_of(decontaminate(empty(spark), items)) == []
    assert all(not r.contaminated for r in decontaminate(docs(spark), items.limit(0)).collect())


def test_blocks_of_items_give_the_same(spark):
    items = load_items(spark.createDataFrame(ITEMS, "item_id long, text string"))
    a, b = scan(docs(spark), items), scan(docs(spark), items, block_chars=1)
    assert rows_of(a) == rows_of(b)


def test_blocks_build_few_automata(monkeypatch):
    """Two blocks over twelve batches, held four at a time: one automaton for each group of batches, and one to begin with."""
    items = [(1, b"one two three"), (2, b"four five six")]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array(["one two three four five six seven"])], ["id", "text"]) for k in range(12)]
    blocks = module.blocks_of(items, 10, 1)
    built, build = [], module.automaton
    monkeypatch.setattr(module, "automaton", lambda *of: built.append(of) or build(*of))
    module._LAST.clear()
    found = list(module._scanner(blocks, 10, held_bytes=4 * batches[0].nbytes)(iter(batches)))
    assert len(blocks) == 2 and len(built) == 1 + 3
    assert [f.column("n_hit").to_pylist() for f in found] == [[6]] * 12 and found[0].column("n_items")[0].as_py() == 2
    assert [f.column("id")[0].as_py() for f in found] == list(range(12))
    built.clear()
    assert len(list(module._scanner(blocks, 10)(iter(batches)))) == 12 and len(built) <= 2


def test_clashing_names_and_long_tokens(spark):
    items = spark.createDataFrame([*ITEMS, (20, "x" * 300_000 + " y")], "item_id long, text string")
    rows = [*TEXTS, (30, "a " + "x" * 300_000 + " y", "s"), (31, "z" * 1_000_000, "s")]
    df = docs(spark, rows).withColumns({c: F.lit("x") for c in ("words", "n_hit", "n_words", "n_items", "spans", "items_sha256", "contaminated")})
    assert rows_of(decontaminate(df, items).drop("spans")) == brute(rows, [*ITEMS, (20, "x" * 300_000 + " y")])
    got = clean(df, items)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in rows if not brute([r], ITEMS)[0][5] and r[0] != 30)


def test_a_table(spark, sf):
    df, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert rows_of(decontaminate(df, bench).drop("spans")) == want
    assert any(r[5] for r in want)


def test_clean_rows_stay_as_they_are(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs(spark)
    hit = [r[5] for r in brute(TEXTS, ITEMS)]
    got = clean(df, items)
    assert got.columns == df.columns and got.count() == hit.count(False)
    assert {r.text for r in got.collect()} == {t for t in (x[1] for x in TEXTS) if not brute([(0, t)], ITEMS)[0][5]}
