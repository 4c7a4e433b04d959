"""Fill-in-the-middle: a text is cut at two of its unit boundaries, and its middle moves to the end.

Overlapping-chunk decomposition. A boundary is a predicate on two adjacent
characters, so a text can be cut into chunks that share one byte with the chunk
before: every adjacent pair lies in one chunk, and chunks are counted apart
from each other. Prefix sums over a text's chunks tell which chunk owns the
boundary of either cut's rank; only those are scanned again, for its offset.

A text of one chunk is its own owner, so that it is counted and cut where it
lies, and nothing is shuffled. Chunks of longer texts are rows dealt over all
tasks; what comes back is one row of counts a chunk, then one row of owners a
text, which meets its text once. Chunks are of UTF-8 bytes: the predicates
never hold inside a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import text_of

#: Bytes of a chunk.
CHUNK = 1 << 16
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Whether a unit ends between the bytes left and right.
BOUNDARIES = {
    "line": lambda left, right: left == 10,
    "word": lambda left, right: _space(left) & ~_space(right),
}
_OUT = "n long, prefix_chars long, middle_chars long, output string"
#: Bytes of results that are handed over at once.
_HELD = 1 << 23


def _space(byte: np.ndarray) -> np.ndarray:
    return (byte == 32) | ((byte >= 9) & (byte <= 13))


def chunk_of(data: np.ndarray, k: int, chunk: int) -> np.ndarray:
    """The bytes whose adjacent pairs are chunk k's: its own, and the last one of the chunk before."""
    return data[max(0, k * chunk - 1) : (k + 1) * chunk]


def boundaries(piece: np.ndarray, unit: str) -> np.ndarray:
    """Offsets in ``piece`` at which a unit begins."""
    return 1 + np.flatnonzero(BOUNDARIES[unit](piece[:-1], piece[1:]))


def _chars(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def _arranged(data: bytes, first: int, second: int, spm: bool, marks: tuple[bytes, ...]) -> tuple[int, int, bytes]:
    p, s, m = marks
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    head = s + suffix + p + prefix if spm else p + prefix + s + suffix
    return _chars(prefix), _chars(middle), head + m + middle


def _handed_over(batch: pa.RecordBatch, keep: int, made: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The first ``keep`` columns of ``batch`` with what was made of each row, so many bytes of output at a time."""
    done, rows, held = 0, [], 0
    for k, row in enumerate(made):
        rows.append(row)
        held += len(row[-1])
        if held > _HELD or k + 1 == batch.num_rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, len(rows)) for i in range(keep)), *columns], names)
            done, rows, held = k + 1, [], 0


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _cut_here(unit: str, marks: tuple[bytes, ...]):
    """Rows (doc_id, form, h1, h2, text) of one chunk each."""

    def cut(text: pa.Scalar, form: str, h1: int, h2: int) -> tuple:
        data = text.as_buffer().to_pybytes()
        at = boundaries(np.frombuffer(data, np.uint8), unit)
        n = len(at) + 1 if data else 0
        if form == "plain":
            return n, None, None, data
        ends = np.concatenate([[0], at, [len(data)]])  # ends[r]: where the first r units end
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        return n, *_arranged(data, int(ends[first]), int(ends[second]), form == "spm", marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, h1, h2 = (batch.column(i).to_pylist() for i in (1, 2, 3))
            yield from _handed_over(batch, 2, map(cut, batch.column(4).cast(pa.binary()), forms, h1, h2), _names(), _KINDS)

    return run


def _names() -> list[str]:
    return ["doc_id", "form", *(c.split()[0] for c in _OUT.split(", "))]


def _to_chunks(chunk: int):
    """Rows (row_id, row_text, text) to rows (row_id, row_text, chunk, piece)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8)
                for at in range(0, -(-len(data) // chunk), 64):
                    pieces = [chunk_of(data, i, chunk).tobytes() for i in range(at, min(at + 64, -(-len(data) // chunk)))]
                    row = [pa.array([batch.column(i)[k].as_py()] * len(pieces), pa.int64()) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*row, pa.array(range(at, at + len(pieces)), pa.int64()), pa.array(pieces, pa.binary())], ["row_id", "row_text", "chunk", "piece"])

    return run


def _count(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [len(boundaries(np.frombuffer(p.as_buffer(), np.uint8), unit)) for p in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["row_id", "row_text", "chunk", "found"])

    return run


def _cut_by_owner(unit: str, chunk: int, marks: tuple[bytes, ...]):
    """Rows (doc_id, form, n, first, owner, rank, second, owner, rank, text): of either cut its rank, its chunk and its rank in there."""

    def offset(data: np.ndarray, n: int, cut: int, owner: int, rank: int) -> int:
        if cut in (0, n):
            return len(data) if cut else 0
        return max(0, owner * chunk - 1) + int(boundaries(chunk_of(data, owner, chunk), unit)[rank - 1])

    def cut(text: pa.Scalar, form: str, n: int, *cuts: int) -> tuple:
        data = text.as_buffer().to_pybytes()
        if form == "plain":
            return n, None, None, data
        ends = [offset(np.frombuffer(data, np.uint8), n, *cuts[i : i + 3]) for i in (0, 3)]
        return n, *_arranged(data, *ends, form == "spm", marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = (batch.column(i).to_pylist() for i in range(1, 9))
            yield from _handed_over(batch, 2, map(cut, batch.column(9).cast(pa.binary()), *told), _names(), _KINDS)

    return run


def _owners(long: DataFrame, unit: str, chunk: int) -> DataFrame:
    """One row a text: its units, and for either cut its rank, the chunk that owns it and its rank among that chunk's boundaries."""
    key = ["row_id", "row_text"]
    pieces = long.select(*key, F.col("text").cast("binary").alias("text")).mapInArrow(_to_chunks(chunk), "row_id long, row_text long, chunk long, piece binary")
    # All columns: the pieces of a text, and of rows that repeat it, go to as many tasks as there are.
    counted = pieces.repartition(*key, "chunk").mapInArrow(_count(unit), "row_id long, row_text long, chunk long, found long")
    counted = counted.groupBy(*key, "chunk").agg(F.max("found").alias("found"))  # rows that repeat an id and a text
    every = Window.partitionBy(*key)
    upto = every.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.withColumns({"before": F.coalesce(F.sum("found").over(upto), F.lit(0)), "n": F.sum("found").over(every) + 1})
    sums = sums.join(long.select(*key, "h1", "h2").distinct(), key)
    ranks = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    sums = sums.withColumns({"first": F.least(*ranks), "second": F.greatest(*ranks)})

    def told(cut: str) -> list[Column]:
        mine = (F.col(cut) > F.col("before")) & (F.col(cut) <= F.col("before") + F.col("found"))
        of = lambda x: F.coalesce(F.max(F.when(mine, x)), F.lit(0))
        return [F.first(cut).alias(cut), of(F.col("chunk")).alias(f"{cut}_owner"), of(F.col(cut) - F.col("before")).alias(f"{cut}_rank")]

    return sums.groupBy(*key).agg(F.first("n").alias("n"), *told("first"), *told("second"))


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    unit: str = "line",
    marks: tuple[str, str, str] = MARKS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    n units: a "line" ends after each \\n, a "word" after the white space [\\x20\\x09-\\x0D] behind it.
    Four draws h1 to h4 from SHA-256 of "seed:id" settle both cuts, h1 and h2 modulo n + 1 units, whether
    the text is changed (h3 % 100 < rate) and its order: spm (h4 % 100 < spm_rate) puts the suffix before the
    prefix, psm after it. See restored() for the way back.

    Defined cases: a null or empty text is empty, has no units and stays plain; so does a text that contains a
    mark, and its lengths are null; a null id is drawn for as the empty string; rows that repeat an id and a text each give a row, all
    alike; an empty table gives no rows; texts are taken whole; other columns are ignored.
    """
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), draws.alias("draws"))
    h = [F.conv(F.substring("draws", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"), "text")
    encoded = tuple(m.encode() for m in marks)
    schema = f"doc_id long, form string, {_OUT}"
    size = F.octet_length("text")
    short = rows.where(size <= chunk).mapInArrow(_cut_here(unit, encoded), schema)
    long = rows.where(size > chunk).withColumns({"row_id": F.xxhash64("doc_id", "text"), "row_text": F.xxhash64("text", F.lit(1))})
    cuts = ["n", "first", "first_owner", "first_rank", "second", "second_owner", "second_rank"]
    routed = long.join(_owners(long, unit, chunk), ["row_id", "row_text"]).select("doc_id", "form", *cuts, "text")
    cut = short.unionByName(routed.mapInArrow(_cut_by_owner(unit, chunk, encoded), schema))
    return cut.select(F.col("doc_id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text behind an output, exactly: no part contains a mark, and no mark begins as another ends."""
    part = F.split(F.col(output), "|".join(map(re.escape, marks)), -1)
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
