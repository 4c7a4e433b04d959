"""Phrases whose words go together, by Suffix-sigma.

At every word of a piece begins a suffix of at most ``max_words`` words, and a
phrase occurs as often as it is a prefix of suffixes. Tasks count equal suffixes of what
they read, and only these counts are shuffled: into ranges of language, first word
and the words after it, so that a first word, or pair, with very many suffixes
fills several ranges. A range is read in falling order, in which suffixes with a common
prefix are neighbours and a longer one comes before its prefixes: one stack, as
deep as a suffix is long, holds the counts of all prefixes that are open, and goes on
by a batch of rows at a time. The empty prefix counts a language's words.

What is a prefix of a range's first or last suffix can go on in the next range: those few are
handed on at any count and added up. All others are whole, and are left out if too rare.
Parts of a phrase occur at least as often as the phrase, so they are among
the prefixes found, and are joined to the phrases afterwards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import UPPER, stored, text_of

#: Characters that end a piece, and those between words.
ENDS, BETWEEN = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Words that a task counts the suffixes of at once, and their most different ones: four numbers below it fit in 63 bits.
AT_ONCE, MOST_WORDS = 1 << 21, 50_000
#: A part of more than one in so many phrases is hot.
HOT_SHARE = 10_000
#: Every character of an ordered suffix's words is above this one, which parts them: prefixes are neighbours in the order of strings.
_PART = "\0"

#: Exact beyond 64 bits: the product is a decimal, its quotient a long.
SCORE = "(CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"

_LOWER = bytes.maketrans(UPPER.encode() + ENDS + BETWEEN, UPPER.lower().encode() + b"\n" * len(ENDS) + b" " * len(BETWEEN))


def _escaped(word: str) -> str:
    return word.replace("\1", "\1\2").replace("\0", "\1\1") if "\0" in word or "\1" in word else word


def _unescaped(col: Column) -> Column:
    """A suffix's words, one blank between them."""
    spaced = F.replace(col, F.lit(_PART), F.lit(" "))
    return F.replace(F.replace(spaced, F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))


class _Suffixes:
    """Words of some texts as numbers, and the counts of their truncated suffixes."""

    def __init__(self, most: int):
        self._most = most
        self._start()

    def _start(self) -> None:
        self._number: defaultdict[bytes, int] = defaultdict()
        self._number.default_factory = self._number.__len__
        self._end, self._none = self._number[b"\n"], self._number[b""]
        self._texts: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        self._words = 0

    def add(self, lang: str, text: bytes) -> None:
        words = text.translate(_LOWER).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(self._number.__getitem__, words), np.int64, len(words))
        self._texts[lang] += [found[found != self._none], np.zeros(1, np.int64)]
        self._words += len(words)

    @property
    def full(self) -> bool:
        return self._words >= AT_ONCE or len(self._number) >= MOST_WORDS

    def counted(self) -> Iterator[pa.RecordBatch]:
        words = pa.array([_escaped(w.decode()) for w in self._number])
        for lang, texts in self._texts.items():
            row = np.concatenate([*texts, np.zeros(self._most, np.int64)])
            columns = [row[: len(row) - self._most]]
            for k in range(1, self._most):
                columns.append(np.where(columns[-1] == self._end, self._end, row[k : len(row) - self._most + k]))
            begins = columns[0] != self._end
            yield from self._rows(lang, words, *_distinct([c[begins] for c in columns], len(words)))
        self._start()

    def _rows(self, lang: str, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = pa.scalar(_escaped(lang))
        for i in range(0, len(counts), 1 << 17):
            numbers = [c[i : i + (1 << 17)] for c in columns]
            parts = [words.take(pa.array(n, mask=n == self._end)) for n in numbers]
            suffix = pc.binary_join_element_wise(head, *parts, _PART, null_handling="skip")
            yield pa.RecordBatch.from_arrays([suffix, pa.array(counts[i : i + (1 << 17)])], ["suffix", "count"])


def _distinct(columns: list[np.ndarray], below: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of columns of numbers under ``below``, and how often each is there."""
    if below ** len(columns) < 1 << 63:
        packed = columns[0]
        for c in columns[1:]:
            packed = packed * below + c
        packed, counts = np.unique(packed, return_counts=True)
        found = []
        for _ in columns:
            packed, c = np.divmod(packed, below)
            found.insert(0, c)
        return found, counts
    rows, counts = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return list(rows.T), counts


def _to_suffixes(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Suffixes(most)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                held.add(lang, text.as_py())
                if held.full:
                    yield from held.counted()
        yield from held.counted()

    return run


class _Stack:
    """The open prefixes of rows that come in falling order: the words of the deepest, the language first, and every depth's count so far."""

    def __init__(self, min_count: int):
        self._least = min_count
        self._path: list[str] | None = None
        self._counts: list[int] = []
        self._first: list[bool] = []  # whether the prefix began with the task's first row

    def _found(self, words: list[str], n: int, is_open: bool) -> tuple:
        return words[0], _PART.join(words[1:]), len(words) - 1, n, is_open

    def _closed(self, depth: int, at_end: bool = False) -> list[tuple]:
        """What is deeper than ``depth`` is left; counts of whole prefixes that are too rare go."""
        path = self._path or []
        deeper = range(depth + 1, len(path) + 1)
        return [self._found(path[:d], self._counts[d - 1], at_end or self._first[d - 1]) for d in deeper if at_end or self._first[d - 1] or d == 1 or self._counts[d - 1] >= self._least]

    def add(self, suffixes: pa.Array, counts: np.ndarray) -> list[tuple]:
        lists = pc.split_pattern(suffixes, _PART)
        sizes = np.diff(lists.offsets.to_numpy())
        codes = np.full((len(sizes), sizes.max()), -1, np.int32)
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = lists.flatten().dictionary_encode().indices.to_numpy()
        same = (codes[1:] == codes[:-1]) & (codes[1:] >= 0)
        shared = np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])  # words that a row has in common with the one before it
        begin, last = suffixes[0].as_py().split(_PART), suffixes[-1].as_py().split(_PART)
        at_start = self._path is None
        for x, y in zip(self._path or [], begin):
            if x != y:
                break
            shared[0] += 1
        out = self._closed(int(shared[0]))
        now: list[int] = []
        first: list[bool] = []
        for d in range(1, codes.shape[1] + 1):
            starts = np.flatnonzero(shared < d)  # the rows at which a prefix of d words ends
            goes_on = shared[0] >= d
            if goes_on:
                starts = np.concatenate([[0], starts])
            sums = np.add.reduceat(counts, starts)
            begins = np.zeros(len(starts), bool)
            if goes_on:
                sums[0] += self._counts[d - 1]
            begins[0] = starts[0] == 0 and (at_start or (goes_on and self._first[d - 1]))
            leaves = (sizes[starts] >= d) & ((sums >= self._least) | begins | (d == 1))
            if len(last) >= d:
                leaves[-1] = False
                now.append(int(sums[-1]))
                first.append(bool(begins[-1]))
            for i in np.flatnonzero(leaves):
                out.append(self._found(suffixes[starts[i]].as_py().split(_PART)[:d], int(sums[i]), bool(begins[i])))
        self._path, self._counts, self._first = last, now, first
        return out

    def end(self) -> list[tuple]:
        return self._closed(0, at_end=True)


def _count_prefixes(min_count: int):
    """Rows (suffix, count) come in falling order; rows (lang, phrase, words, count, open) leave."""
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(min_count)

        def leave(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["lang", "phrase", "words", "count", "open"])

        for batch in batches:
            if batch.num_rows:
                yield from leave(stack.add(batch.column(0), batch.column(1).to_numpy()))
        yield from leave(stack.end())

    return run


def phrase_counts(docs: DataFrame, max_words: int = 4, min_count: int = 30, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, count) of phrases of 1 to ``max_words`` words, parted by "\\0" and escaped, that occur ``min_count`` times; words = 0: all words of the language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    # The language is a suffix's first part: rows are dealt, sorted and compared by one string.
    suffixes = rows.mapInArrow(_to_suffixes(max_words), "suffix string, count long")
    ordered = suffixes.repartitionByRange("suffix").sortWithinPartitions(F.desc("suffix"))
    found = ordered.mapInArrow(_count_prefixes(min_count), "lang string, phrase string, words long, count long, open boolean")
    found = stored(found.withColumn("lang", _unescaped(F.col("lang"))), "phrases")
    whole = found.where("not open").drop("open")
    met = found.where("open").groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count"))
    return whole.unionByName(met.where((F.col("count") >= min_count) | (F.col("words") == 0)))


def _with_count(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of their ``part``. Parts of very many rows, fewer than HOT_SHARE of them, are broadcast."""
    of = counts.select("lang", F.col("phrase").alias(part), F.col("count").alias(name))
    used = rows.groupBy("lang", part).agg(F.count(F.lit(1)).alias("used"))
    floor = max(1, rows.count() // HOT_SHARE)
    hot = F.broadcast(used.where(F.col("used") > floor).drop("used").join(of, ["lang", part]))
    rest = rows.join(hot, ["lang", part], "left_anti").join(of, ["lang", part])
    return rows.join(hot, ["lang", part]).unionByName(rest)


def collocations(
    docs: DataFrame,
    max_words: int = 4,
    min_count: int = 30,
    per_lang: int = 2000,
    covered: int = 80,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``per_lang`` phrases of 2 to ``max_words`` words.

    A text is lower-cased (A-Z), split at [.,;:!?\\x0A-\\x0D] into pieces and those at [\\x20\\x09] into words. A phrase occurs a >= min_count times; cut after
    some of its words, both parts occur l and r times, and its score is the least floor(2000000 a / (l + r)) of all cuts, the earliest of equal ones.
    A phrase inside a longer one of at least ``covered`` in a hundred of its count is left out, whether or not the longer one is. n is all words of the language.
    Order: score and a falling, then the phrase by its bytes.

    Defined cases: a null text is empty and has no words; a null language is "und"; repeated rows each count; an
    empty table gives no rows; texts are read whole; ids and other columns are ignored.
    """
    counts = phrase_counts(docs, max_words, min_count, lang_col, text_col)
    counts = stored(counts, "phrase-counts")
    found = counts.where("words >= 2").select("lang", "phrase", "words", F.col("count").alias("a"))

    # Phrases inside longer ones: the most that any longer one occurs.
    words = F.split("phrase", _PART)
    spans = [(i, n) for n in range(2, max_words) for i in range(max_words - n + 1)]
    inside = F.array(*(F.when(F.col("words") >= F.lit(max(i + n, n + 1)), F.array_join(F.slice(words, i + 1, n), _PART)) for i, n in spans))
    longer = found.where("words > 2").select("lang", "a", F.explode(inside).alias("phrase")).where("phrase is not null")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    is_covered = F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * covered, F.lit(False))
    kept = stored(found.join(longer, ["lang", "phrase"], "left").where(~is_covered).drop("longer"), "phrases-kept")

    k = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words").cast("int") - 1), lambda i: F.struct(
        F.array_join(F.slice(words, F.lit(1), i), _PART).alias("first"),
        F.array_join(F.slice(words, i + 1, F.size(words)), _PART).alias("rest"),
    ))).alias("k", "parts")
    cuts = stored(kept.select("lang", "phrase", "a", k).select("lang", "phrase", "a", "k", "parts.*"), "phrase-cuts")
    cuts = stored(_with_count(cuts, counts, "first", "l"), "phrase-cuts-left")
    cuts = _with_count(cuts, counts, "rest", "r")
    least = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least).select("lang", _unescaped(F.col("phrase")).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= per_lang)
    all_words = counts.where("words = 0").select("lang", F.col("count").alias("n"))
    return ranked.join(all_words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
