import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from folioscope.llm import pieces as P
from folioscope.llm.queries_pieces import op12_sentencepiece
from tests.llm.cases import TEXTS, docs, empty, rows_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return P.PieceEncoder(MODEL)


def ids(encoder, text):
    made = encoder(text)
    return [int.from_bytes(made[i : i + 4], "little") for i in range(0, len(made), 4)]


def test_ids_are_the_librarys(encoder, library):
    rng = random.Random(2)
    letters, known = "ab  eth\n▁é日本x1<>s/0xA\x00①\t", list(encoder.table.id)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randint(0, 8))).replace(P.BLANK, " ") for _ in range(3000)]
    texts += [a + " " * k + b for k in range(120) for a in ("", "a", "\n") for b in ("", "a", "the ")]
    texts += ["a" * 5000, "ab" * 3000, "日本" * 2000, "=" * 3000, "<s>a</s><unk><0x0A>", "ﬁ é é　x�"]
    for text in texts:
        assert ids(encoder, text) == library.encode(text), text


def test_whole_texts_without_cuts_at_words(encoder, library):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["the ", "  ", "re", "ing", "é", "x\n", "▁"]) for _ in range(rng.randint(0, 60)))
        assert encoder.table.encode(library.normalize(text)) == library.encode(text)


def test_memories_start_anew(library, monkeypatch):
    monkeypatch.setattr(P, "MEMORY_WORDS", 3)
    monkeypatch.setattr(P, "MEMORY_PAIRS", 5)
    small = P.PieceEncoder(MODEL)
    for text in ("one two three four five six", "seven eight nine ten", "one two three"):
        assert ids(small, text) == library.encode(text)
    assert small.table._told <= 5


def test_cases(spark, library):
    clash = docs(spark).withColumns({c: F.lit("x") for c in ("ids", "decoded", "n_tokens")})
    made = P.decode(P.encode(clash, MODEL), MODEL)
    want = []
    for i, t, _ in TEXTS:
        found = library.encode(t or "", add_eos=True)
        want.append((i, found, library.decode(found)))
    assert rows_of(made) == sorted(want, key=repr)
    assert rows_of(P.decode(P.encode(empty(spark), MODEL), MODEL)) == []
    assert [r.decoded for r in P.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()] == [""]


def test_query_against_the_library(spark, sf, library):
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        found = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(found), hexed(" ".join(map(str, found))), hexed(library.decode(found))))
    assert rows_of(op12_sentencepiece(spark, sf)) == sorted(want, key=repr)
