import hashlib
import random
import re

from pyspark.sql import functions as F

from folioscope.llm import fill_middle as M
from tests.llm.cases import TEXTS, docs, empty, rows_of

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"}


def brute(doc_id, text, unit="line", rate=100):
    text = text or ""
    parts = re.findall(UNITS[unit], text)
    assert "".join(parts) == text
    n = len(parts)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in M.MARKS) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


MORE = [
    (20, "\n\n\n", "a"),
    (21, "a\n", "a"),
    (22, "x <S> y\nz\n", "a"),
    (23, "<P\n<\n<S\n>P>\n<M", "a"),
    (24, "é\n日本\n" * 40, "b"),
    (24, "é\n日本\n" * 40, "b"),
    (None, "line\n" * 50, "b"),
    (25, "no end of line " * 30, "b"),
]


def test_against_brute_force_by_chunks_of_any_size(spark):
    rows = [r for r in TEXTS if r[0] != 7] + MORE
    want = sorted((brute(i, t) for i, t, _ in rows), key=repr)
    for chunk in (1, 7, 64, M.CHUNK):
        got = M.fill_in_middle(docs(spark, rows).withColumns({c: F.lit("x") for c in ("form", "h1", "chunk", "row_id")}), chunk=chunk)
        assert rows_of(got) == want, chunk
        back = got.select("doc_id", M.restored().alias("text"))
        assert rows_of(back) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert rows_of(M.fill_in_middle(empty(spark))) == []


def test_long_texts_and_words(spark):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice(["ab ", "é", "\n", "日本", "\t", "word\n"]) for _ in range(rng.randint(1, 6000))), "a") for k in range(40)]
    for unit in UNITS:
        want = sorted((brute(i, t, unit) for i, t, _ in rows), key=repr)
        assert rows_of(M.fill_in_middle(docs(spark, rows), unit=unit, chunk=1000)) == want
    assert rows_of(M.fill_in_middle(docs(spark, rows), rate=30)) == sorted((brute(i, t, rate=30) for i, t, _ in rows), key=repr)


def test_chunks_overlap_by_one_and_only_owners_are_scanned_again():
    import numpy as np

    data = np.frombuffer(b"a\nb\n\nccc\n\n" * 9, np.uint8)
    for chunk in (1, 2, 5, 1000):
        found = []
        for k in range(-(-len(data) // chunk)):
            piece = M.chunk_of(data, k, chunk)
            found += [max(0, k * chunk - 1) + int(p) for p in M.boundaries(piece, "line")]
        assert found == [i for i in range(1, len(data)) if data[i - 1] == 10]
