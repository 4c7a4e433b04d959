"""Toxicity by noisy-channel deobfuscation.

1. A character language model (trigrams over a-z, "other letter" and
   boundary) is counted over all documents: per task an array of fixed size,
   then summed.
2. What looks written around a filter -- leetspeak, letters set apart, long
   repetitions, symbols inside words -- becomes a lattice of what it may
   stand for, and Viterbi picks the likeliest letters under the model and
   the channel's costs. Plain words have a lattice of one path and stay.
3. Plain and restored words are looked up in a lexicon of words that mark
   label 1, learnt from labelled rows; a logistic regression makes
   three sums of their log-odds a chance. It is fitted with each half of the
   sample scored by the other half's lexicon.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored, text_of
from folioscope.llm.logistic import Logistic, fit
from folioscope.llm.quality import sampled, training_rows

# --- Fixed values: what a character may stand for, with the channel's cost of each reading.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
LEET_COST, STAR_COST, DROP_COST, DROP_STAR_COST, DROP_LAST_DIGIT_COST, STRETCH_COST = 1.0, 3.0, 14.0, 4.0, 2.5, 8.0
# --- End of fixed values.

#: Tokens that a worker remembers, and their most characters.
KNOWN_TOKENS, KNOWN_CHARS = 200_000, 40
_SIZE = 28  # 0 boundary, 1-26 a-z, 27 other letter
_DROPPED = 255
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[0x80:0xC0] = _DROPPED  # the first byte stands for the character
_CLASS[0xC0:] = 27
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))

_ODD = re.compile(r"[0-9@$|+!*_]+|(?<=[^\W\d_])[.\-](?=[^\W\d_])|([^\W\d_])\1\1+")
_SPACED = re.compile(r"(?<![^\W_])[^\W_@$!|+](?:[ ._*\-]{1,2}[^\W_]|[ ._*\-]{1,2}[@$!|+]){2,}(?![^\W_])")
_EDGE = " \t\r\n\x0b\x0c.,;:?!\"'()[]{}<>/\\"
_RUN_AT_END = re.compile(r"([^\w\s])\1\1+$")
_WHITE = re.compile(r"\s")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        texts = batch.column(0).cast(pa.binary())
        for i in range(0, len(texts), 256):
            data = b" ".join(t.as_py() for t in texts[i : i + 256])
            c = _CLASS[np.frombuffer(b" " + data + b" ", np.uint8)]
            c = c[c != _DROPPED].astype(np.int64)
            first = np.where(c[1:-1] == 0, 0, c[:-2])  # what stands before a boundary doesn't matter
            total += np.bincount((first * _SIZE + c[1:-1]) * _SIZE + c[2:], minlength=_SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])


def language_model(docs: DataFrame, text_col: str = "text", smooth: float = 5.0) -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c], from every text of ``docs``. The driver gets 28^3 sums, whatever the size of the corpus."""
    counts = docs.select(text_of(text_col).alias("text")).mapInArrow(_count, "code long, n long")
    n = np.zeros(_SIZE**3)
    for row in counts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        n[row.code] = row.n
    n = n.reshape(_SIZE, _SIZE, _SIZE)
    pairs = n.sum(axis=0)
    p2 = (pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * _SIZE)
    return np.log((n + smooth * p2[None]) / (n.sum(axis=2, keepdims=True) + smooth))


class Restorer:
    """Viterbi over the lattice of a token."""

    def __init__(self, model: np.ndarray):
        self._p = model.tolist()
        self._known: dict[str, str] = {}

    def _readings(self, token: str) -> list[list[tuple[str, float]]]:
        """What each run of one character may stand for: once or twice what is written, as a letter or through LEET, or nothing.

        The costs are those that restore most of the corpus's own words after
        they are written oddly in five ways (tests/llm/test_classify.py).
        Without a price on reading two symbols as one letter, and a high one
        on dropping a symbol within a word, the model takes the shorter word.
        """
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            n = min(j - i, 2)
            if c.isalpha():
                # Two letters in a row are ordinary; more stand for one or two.
                out.append([(c * n, 0.0), (c, STRETCH_COST if j - i == 2 else 0.0)] if n > 1 else [(c, 0.0)])
            else:
                costs = [(x * k, LEET_COST * k + STRETCH_COST * (n - k)) for x in LEET.get(c, "") for k in range(1, n + 1)]
                drop = DROP_LAST_DIGIT_COST * (j - i) if token[i:].isdigit() else DROP_COST if costs else 0.0
                if c == "*":
                    costs, drop = [(x, STAR_COST) for x in "aeiou"], DROP_STAR_COST
                out.append([*costs, ("", drop)])
            i = j
        return out

    def _decode(self, token: str) -> str:
        p = self._p
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for readings in self._readings(token):
            new: dict = {}
            for (a, b), (score, path) in states.items():
                for letters, cost in readings:
                    s, x, y = score - cost, a, b
                    for c in letters:
                        z = ord(c) - 96 if "a" <= c <= "z" else 27
                        s += p[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or s > new[x, y][0]:
                        new[x, y] = (s, (letters, path))
            states = new
        best, path = max(((s + p[a][b][0], path) for (a, b), (s, path) in states.items()), key=lambda t: t[0])
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters))

    def __call__(self, token: str) -> str:
        if len(token) > KNOWN_CHARS:
            return self._decode(token)
        found = self._known.get(token)
        if found is None:
            if len(self._known) > KNOWN_TOKENS:
                self._known.clear()
            found = self._known[token] = self._decode(token)
        return found

    def restored(self, text: str) -> Iterator[str]:
        """Words behind what is written oddly in ``text`` (A-Z lower-cased)."""
        done = 0
        for m in _ODD.finditer(text):
            if m.start() < done:
                continue
            start = max(text.rfind(" ", done, m.start()), text.rfind("\n", done, m.start()), text.rfind("\t", done, m.start()), done - 1) + 1
            end = _WHITE.search(text, m.end())
            done = end.start() if end else len(text)
            token = _RUN_AT_END.sub("", text[start:done].strip(_EDGE)).strip(_EDGE)
            if any(c.isalpha() for c in token) and (not token.isalpha() or _ODD.search(token)):
                yield self(token)
        for m in _SPACED.finditer(text):
            joined = self(re.sub(r"[ ._*\-]", "", m[0]))
            # A word may stand between other single letters.
            for i in range(len(joined)):
                for j in range(i + 3, min(len(joined), i + 24) + 1):
                    yield joined[i:j]

    def words(self, text: bytes, among: Container[bytes] | None = None) -> set[bytes]:
        """Plain and restored words; with ``among`` only those in it, so that a long text of letters set apart takes no room."""
        found = set(text.translate(_LETTERS).split())
        restored = (w.encode() for w in self.restored(text.lower().decode()))
        if among is None:
            return found.union(restored)
        return {w for w in found if w in among}.union(w for w in restored if w in among)


def _words(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = [[w.decode("utf-8", "replace") for w in restore.words(t.as_py())] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.string())), batch.column(2), batch.column(3)],
                ["id", "words", "y", "half"],
            )

    return run


@dataclass
class Toxicity:
    language: np.ndarray
    lexicon: dict[bytes, float]
    regression: Logistic

    def score(self, words: set[bytes]) -> float:
        return float(self.regression(np.array([_sums(words, self.lexicon)]))[0])


def _sums(words, lexicon: dict) -> list[float]:
    hits = [lexicon[w] for w in words if w in lexicon] if len(words) < len(lexicon) else [v for w, v in lexicon.items() if w in words]
    return [min(sum(hits), 40.0), max(hits, default=0.0), min(len(hits), 5)]


def _lexicon(counts, halves: tuple[int, ...], totals: dict, min_docs: int, least: float, most_words: int) -> dict[str, float]:
    n1 = sum(totals.get((h, 1), 0) for h in halves)
    n0 = sum(totals.get((h, 0), 0) for h in halves)
    by: dict[str, list[int]] = {}
    for word, half, ones, zeros in counts:
        if half in halves:
            entry = by.setdefault(word, [0, 0])
            entry[0] += ones
            entry[1] += zeros
    scored = []
    for word, (ones, zeros) in by.items():
        odds = np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1))
        if ones >= min_docs and odds >= least:
            scored.append((-ones, word, float(odds)))
    return {word: odds for _, word, odds in sorted(scored)[:most_words]}


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
    min_docs: int = 3,
    min_odds: float = 2.0,
    max_lexicon: int = 5_000,
    seed: int = 42,
) -> Toxicity:
    """The language model is counted over all documents; the lexicon and the regression take about ``max_labelled`` labelled rows.

    Labels are learnt only where crc32(id as text) mod 5 isn't 0. Null labels
    don't count; several labels of one id count as the largest; of several rows of an id one counts.
    """
    language = language_model(docs, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training_rows(id_col))
    known = known.groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    known = sampled(known, "k", max_labelled, seed)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("text"))
    # Copies share a half, or else one half would know the other's texts.
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    rows = rows.join(F.broadcast(known), "k").select("k", "text", "y", half.alias("half"))
    # Of several rows of an id the one whose text has the smallest hash: the driver's rows are bounded by ids.
    rows = rows.groupBy("k").agg(F.min_by(F.struct("text", "y", "half"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("k", "r.*")
    words = stored(rows.mapInArrow(_words(language), "id long, words array<string>, y int, half int"), "labelled-words")
    totals = {(r.half, r.y): r.n for r in words.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = (
        words.select("half", "y", F.explode("words").alias("word"))
        .groupBy("word", "half")
        .agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros"))
    )
    # Of max_labelled rows, the words that at least min_docs of label 1 have; both halves of each.
    often = counts.groupBy("word").agg(F.sum("ones").alias("s")).where(F.col("s") >= min_docs)
    counts = [tuple(r) for r in counts.join(often, "word", "left_semi").select("word", "half", "ones", "zeros").collect()]
    by_half = {h: _lexicon(counts, (1 - h,), totals, max(2, min_docs - 1), min_odds, max_lexicon) for h in (0, 1)}
    lexicon = _lexicon(counts, (0, 1), totals, min_docs, min_odds, max_lexicon)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sums(set(w), by_half[h]) for w, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])

    found = words.select("words", "half", "y").mapInArrow(sums, "y int, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, 3)
    y = np.array(found["y"].to_pylist(), float)
    return Toxicity(language, {w.encode(): v for w, v in lexicon.items()}, fit(x, y, l2=0.1))


def _scorer(model: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.language)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            x = [_sums(restore.words(t.as_py(), model.lexicon), model.lexicon) for t in texts]
            p = model.regression(np.array(x).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, held_out, score, predicted), one row per row of ``docs``.

    Defined cases: null and empty texts get the score of a text without
    marked words; a null id counts as held out (crc32 of the empty string is
    0); repeated rows each give a row; without usable labels every document
    gets the same score; an empty table gives no rows; texts are read
    whole; other columns are ignored.
    """
    model = train(docs, labels, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(model), "id long, score double")
    return out.select(
        F.col("id").alias(id_col),
        (~training_rows("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, F.lit(1)).otherwise(F.lit(0)).alias("predicted"),
    )
