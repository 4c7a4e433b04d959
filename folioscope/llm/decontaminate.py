"""Benchmark decontamination with one Aho-Corasick automaton per block of test items.

Items and documents are normalised alike: A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. An item's windows are its runs of
``window`` words (all of it, if shorter). The automaton holds the windows,
each between single spaces, so that matches are whole words; a document's
normalised bytes are scanned once per automaton, and matches are
mapped back to words and to code points of the original text.

Items ship to the tasks as text. All of them make one automaton up to
``block_chars`` characters of windows; more are cut into blocks. A worker
holds one automaton at a time: it scans about HELD_BYTES of documents by all
blocks in turn, the next documents by the same blocks backwards, and so builds
(blocks - 1) automata for that much text. Memory is bounded whatever the number
of items, and no document is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_of

#: A-Z to a-z; every other ASCII byte that isn't a letter or digit to a space; bytes of other code points stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
#: The same words before A-Z are lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Item = tuple[int | None, bytes]
#: Characters of windows that one automaton takes.
BLOCK_CHARS = 50_000_000
#: Bytes of documents that are held while one automaton after another scans them.
HELD_BYTES = 128 << 20


def words_of(text: bytes) -> list[bytes]:
    # On bytes split() cuts at ASCII white space only, of which the table leaves spaces.
    return text.translate(_TABLE).split()


def windows_of(text: bytes, window: int) -> list[list[bytes]]:
    words = words_of(text)
    if not words:
        return []
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))]


def automaton(items: list[Item], window: int) -> ahocorasick.Automaton | None:
    """Values are (bytes of the pattern between its spaces, words, numbers of the items that have it)."""
    owners: dict[bytes, set[int]] = {}
    for number, (_, text) in enumerate(items):
        for w in windows_of(text, window):
            owners.setdefault(b" ".join(w), set()).add(number)
    if not owners:
        return None
    made = ahocorasick.Automaton()
    for pattern, numbers in owners.items():
        # Bytes as Latin-1 characters: one code unit per byte, and cheap to make.
        made.add_word(f" {pattern.decode('latin-1')} ", (len(pattern), pattern.count(b" ") + 1, tuple(numbers)))
    made.make_automaton()
    return made


def blocks_of(items: list[Item], window: int, block_chars: int) -> list[list[Item]]:
    blocks: list[list[Item]] = []
    held = block_chars + 1
    for item in items:
        size = (len(item[1]) + 1) * window
        if held + size > block_chars:
            blocks.append([])
            held = 0
        blocks[-1].append(item)
        held += size
    return blocks


def automaton_of(block: list[Item], window: int) -> ahocorasick.Automaton | None:
    """The automaton of a block; the last one made outlasts its task, as the next task of the worker asks for it too."""
    name = hashlib.sha256(repr((window, block)).encode()).digest()
    if _LAST.get("name") != name:
        _LAST.clear()  # before the next one is built: they don't stand in memory together
        _LAST.update(name=name, made=automaton(block, window))
    return _LAST["made"]


_LAST: dict = {}


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    group, held = [], 0
    for batch in batches:
        group.append(batch)
        held += batch.nbytes
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def _plain(text: bytes) -> tuple[int, str]:
    """Number of words, and the words between single spaces, bytes as Latin-1 characters."""
    words = words_of(text)
    return len(words), f" {b' '.join(words).decode('latin-1')} " if words else ""


def _scanner(blocks: list[list[Item]], window: int, held_bytes: int = HELD_BYTES):
    names = [[str(i) if i is not None else "" for i, _ in b] for b in blocks]

    def found_in(batch: pa.RecordBatch, n_words: np.ndarray, hits: dict[int, list], items: dict[int, set[str]]) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary())
        n_hit = np.zeros(len(texts), np.int64)
        spans: list[list] = [[] for _ in texts]
        for k, found in hits.items():
            text = texts[k].as_py()
            at = np.frombuffer(_plain(text)[1].encode("latin-1"), np.uint8)
            starts = np.flatnonzero(at == 32)[:-1] + 1  # byte where each word starts
            first = np.searchsorted(starts, np.array([f for f, _ in found]))
            change = np.zeros(n_words[k] + 1, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, first + np.array([c for _, c in found]), -1)
            hit = np.cumsum(change[:-1]) > 0
            n_hit[k] = hit.sum()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            place = [m.span() for m in _WORD.finditer(text.decode())]
            spans[k] = [{"start": place[a][0], "end": place[b - 1][1]} for a, b in zip(edges[::2], edges[1::2])]
        joined = [sorted(items.get(k, ())) for k in range(len(texts))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_words),
                pa.array(n_hit),
                pa.array([len(x) for x in joined], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in joined]),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            ["id", "n_words", "n_hit", "n_items", "items_sha256", "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = list(range(len(blocks)))
        # One automaton needs no documents held.
        for group in _held(batches, held_bytes if len(blocks) > 1 else 0):
            n_words = [np.zeros(len(batch), np.int64) for batch in group]
            hits: list[dict[int, list]] = [{} for _ in group]
            items: list[dict[int, set[str]]] = [{} for _ in group]
            for number in order or [None]:
                made = None if number is None else automaton_of(blocks[number], window)
                for n, batch in enumerate(group):
                    for k, text in enumerate(batch.column(1).cast(pa.binary())):
                        n_words[n][k], plain = _plain(text.as_py())
                        for end, (length, count, owners) in made.iter(plain) if made else ():
                            hits[n].setdefault(k, []).append((end - length, count))
                            items[n].setdefault(k, set()).update(names[number][o] for o in owners)
            order.reverse()
            for n, batch in enumerate(group):
                yield found_in(batch, n_words[n], hits[n], items[n])

    return run


def load_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", max_chars: int = 1 << 28) -> list[Item]:
    """The test items on the driver, after a check of their size: they are a stated set, not a part of the corpus."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t")).distinct()
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if chars > max_chars:
        raise ValueError(f"test items hold {chars} bytes; pass them in parts of at most {max_chars}")
    found = [(r["i"], bytes(r["t"].encode())) for r in rows.collect()]
    return sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def scan(
    docs: DataFrame,
    items: list[Item],
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, spans), one row per row of ``docs``.

    ``spans`` are the hit stretches as [start, end) in code points of the
    original text.

    Defined cases: null and empty texts have no words; an item without words
    has no window; items with equal windows all count; a null item id is
    written as an empty string; rows that repeat an item count once; repeated documents and
    null ids each give a row; without items nothing is hit; an empty table
    gives no rows; texts of any length are scanned whole; other columns are
    ignored.
    """
    blocks = blocks_of(items, window, block_chars)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    schema = (
        "id long, n_words long, n_hit long, n_items long, items_sha256 string, "
        "spans array<struct<start: long, end: long>>"
    )
    out = rows.mapInArrow(_scanner(blocks, window), schema)
    return out.withColumnRenamed("id", id_col)


def _clean(blocks: list[list[Item]], window: int, position: int):
    scanner = _scanner(blocks, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waiting.append(batch)
                column = batch.column(position).fill_null("")
                yield pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], ["id", "text"])

        for found in scanner(texts()):
            yield waiting.pop(0).filter(pc.equal(found.column("n_hit"), 0))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they are.

    It goes by rows and moves no text. Defined cases: null and empty texts
    have no words and stay; ids aren't read, so they may be null or
    repeated, and rows that repeat whole share one fate; columns may have
    any names and types; without items all rows stay; an empty table gives
    no rows; texts of any length are scanned whole.
    """
    blocks = blocks_of(load_items(benchmark), window, BLOCK_CHARS)
    return docs.mapInArrow(_clean(blocks, window, docs.columns.index(text_col)), docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """scan() with ``contaminated`` (n_hit > 0)."""
    return scan(docs, load_items(benchmark), window).withColumn("contaminated", F.col("n_hit") > 0)
