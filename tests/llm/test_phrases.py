import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import phrases as P
from tests.llm.cases import TEXTS, docs, empty, rows_of


def brute(rows, max_words=4, min_count=30, per_lang=2000, covered=80):
    """rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, max_words + 1):
                    if i + m <= len(w):
                        f[lang, tuple(w[i : i + m])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, p), longer in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and 100 * longer >= covered * found[lang, p[i:j]]:
                    gone.add((lang, p[i:j]))
    by_lang = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang, ps in by_lang.items():
        for rank, (score, a, p, l, r) in enumerate(sorted(ps)[:per_lang], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=repr)


def texts(seed, count):
    rng = random.Random(seed)
    words = ["new", "york", "City", "the", "of", "in", "of the", "é", "日本", "a\x00b", "a", "a\x01", "\x01\x02", "b\x00", "x~y", "ﬁ"]
    marks = [" ", " ", "  ", "\t", ". ", ",", "\n", " "]
    langs = ["en", "en", "en", "de", None, "und", ""]
    return [(k, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60))), rng.choice(langs)) for k in range(count)]


def test_against_brute_force(spark):
    rows = texts(1, 150)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    want = {m: brute([(r[2], r[1]) for r in rows], min_count=m) for m in (2, 5, 30)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, m in (("1", 5), ("4", 2), ("13", 2), ("13", 30)):  # more ranges cut more open prefixes
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert rows_of(P.collocations(table, min_count=m)) == want[m]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows_of(P.collocations(table, min_count=3, max_words=3, per_lang=7, covered=50)) == brute([(r[2], r[1]) for r in rows], 3, 3, 7, 50)


def test_a_hot_first_word_and_hot_parts(spark, monkeypatch):
    """A pair at a third of all words fills several ranges, and its parts are broadcast."""
    monkeypatch.setattr(P, "HOT_SHARE", 20)
    rng = random.Random(2)
    rows = [("en", " ".join(["same pair " + rng.choice("abcdefgh") + " " + rng.choice("abcdefgh") for _ in range(40)])) for _ in range(60)]
    table = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert rows_of(P.collocations(table, min_count=5)) == brute(rows, min_count=5)


def test_cases(spark):
    clash = docs(spark).drop("lang").withColumn("lang", F.col("source")).withColumns({c: F.lit("x") for c in ("suffix", "count", "phrase", "words", "a", "l", "k")})
    assert rows_of(P.collocations(clash, min_count=2)) == brute([(s, t) for _, t, s in TEXTS], min_count=2)
    assert rows_of(P.collocations(empty(spark).withColumnRenamed("source", "lang"))) == []


def test_many_words_and_flushes(spark, monkeypatch):
    rows = texts(3, 80)
    want = brute([(r[2], r[1]) for r in rows], min_count=3)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    held = P._Suffixes(4)
    for _, text, lang in rows:
        held.add(lang or "und", text.encode())
    whole = sum(b.column(1).to_numpy().sum() for b in held.counted())
    assert whole == sum(len(re.findall(r"[^\s.,;:!?]+", re.sub(r"[\x0A-\x0D]", " ", t))) for _, t, _ in rows)
    assert rows_of(P.collocations(table, min_count=3)) == want
    columns = [np.array(c) for c in ([5, 5, 7], [1, 1, 2], [0, 0, 1 << 40])]
    found, counts = P._distinct(columns, 1 << 41)  # too wide to be packed
    assert [c.tolist() for c in found] == [[5, 7], [1, 2], [0, 1 << 40]] and counts.tolist() == [2, 1]


def test_scores_are_exact_beyond_64_bits(spark):
    for a, l, r in ((1 << 62, (1 << 62) + 1, (1 << 62) + 12345), (10**18 + 1, 10**18 + 7, 9 * 10**18), (30, 41, 1)):
        row = spark.sql(f"SELECT {a}L AS a, {l}L AS l, {r}L AS r").selectExpr(f"{P.SCORE} AS score").first()
        assert row.score == 2000000 * a // (l + r)
