"""SimHash near-duplicates of a stated similarity: candidates by anchors over a long fingerprint, checked exactly.

A document's fingerprint has ``prints`` x 64 bits over its shingles of
``words`` words. Two sets of shingles of Jaccard similarity J differ in a bit
with chance p = acos(2J / (1 + J)) / pi, so that documents are candidates if they
differ in at most the share of bits expected at ``similarity``, and 0.02 for chance.

Such candidates are too wide for one code over the whole fingerprint, so it is cut
into blocks of 23 bits, each covered by the shortened Hamming code [23, 18]. A
fingerprint goes to every code word within 2 of each block, 9 on average. Two
blocks that differ in at most 2 bits meet at an anchor between them: of 16
such pairs 15 do, as the shortened code leaves a few words 2 away. Fingerprints
that meet at an anchor are compared over all their bits. At J = 0.8 a block
has 2 differing bits or fewer with chance 0.30, and one of eight blocks has with
0.93; at 0.9 with 0.99. What two documents meet by is chance, so links can be
missed: README gives the measured recall.

No candidate links before its sets of shingles have been compared. To check
all pairs of a group of n near copies would take n^2 sets, so it goes in two rounds:

1. Of sets with one fingerprint the first stands for all. A task leaves of its candidates a forest of least
   differing bits, some n pairs; these are checked, and so is each set against the one that stands for it. The anchors
   of one block go first, and those of the others join only what it has left apart, so that a large group isn't found eight times.
2. Where that has parted what candidates connect, all candidates between the parts are checked as well, set by set.

Any link between two documents that were candidates is then either checked or
within a group that checked links connect already: groups are those of all checked candidates.

Skew: documents with equal sets are one row; a pair's sets meet at the end with
more pairs, which is cut into blocks of them; an anchor of more than ``cell_limit`` rows is split
into blocks of rows, each pair of which is another task's; sets that very many documents have are broadcast when they are named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioscope.llm.common import stored, text_of
from folioscope.llm.simhash import SEED, components, contract, looked_up

#: Bits of a block; columns of its parity check are the numbers 1 to BLOCK in five bits.
BLOCK = 23
_PAIRS_AT_ONCE = 1 << 18
_BOTH, _LEFT, _RIGHT = 0, 1, 2


def expected_share(similarity: float) -> float:
    """Share of bits in which two sets of that Jaccard similarity differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float, prints: int) -> int:
    return round(64 * prints * (expected_share(similarity) + 0.02))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash of the same shingle: the finaliser of splitmix64 over h + k steps of its stream."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted uint64 hashes of UTF-8 ``text``'s shingles, each once: A-Z lower-cased, words cut at [\\x20\\x09-\\x0D]."""
    w = text.lower().split()  # on bytes both touch ASCII only
    if not w:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    shingles = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64))


def long_fingerprint(text: bytes, words: int = 5, prints: int = 3) -> np.ndarray:
    """uint64 x prints; each shingle counts once."""
    return _fingerprint(shingle_hashes(text, words), prints)


def _fingerprint(h: np.ndarray, prints: int) -> np.ndarray:
    found = []
    for k in range(prints):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 65536):
            part = np.unpackbits(_mixed(h[i : i + 65536], k).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += part.sum(axis=0, dtype=np.int64)
        found.append(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])
    return np.array(found, np.uint64)


def _set_names(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set that tell it from others: both equal, the sets are taken to be equal."""
    return int(h.sum(dtype=np.uint64)), int(_mixed(h, 11).sum(dtype=np.uint64))


def _fingerprints(words: int, prints: int):
    names = ["id", *(f"f{k}" for k in range(prints)), "s0", "s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1).cast(pa.binary()):
                h = shingle_hashes(t.as_py(), words)
                found.append([*_fingerprint(h, prints), *_set_names(h)])
            values = np.array(found, np.uint64).reshape(batch.num_rows, prints + 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, k]) for k in range(prints + 2))], names)

    return run


def _shingles(words: int):
    """Rows (node, s0, s1, text) to rows (node, set), some at a time: a set takes about as much room as its text. An id's other texts go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.select(["node", "s0", "s1"]).to_pandas().to_numpy()
            nodes, part, held = [], [], 0
            for k, t in enumerate(batch.column(3).cast(pa.binary())):
                h = shingle_hashes(t.as_py(), words)
                if np.array_equal(np.array(_set_names(h), np.uint64).view(np.int64), wanted[k, 1:]):
                    nodes.append(wanted[k, 0])
                    part.append(h.view(np.int64))
                    held += len(h)
                if part and (held > 1 << 20 or k + 1 == batch.num_rows):
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
                    sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), sets], ["node", "set"])
                    nodes, part, held = [], [], 0

    return run


def _bits_of(fps: np.ndarray, block: int) -> np.ndarray:
    """Bits [23 block, 23 block + 23) of fingerprints (rows x prints)."""
    first = BLOCK * block
    k, shift = divmod(first, 64)
    x = fps[:, k] >> np.uint64(shift)
    if shift + BLOCK > 64:
        x = x | (fps[:, k + 1] << np.uint64(64 - shift))
    return (x & np.uint64((1 << BLOCK) - 1)).astype(np.int64)


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into x, code word) of every code word within 2 of each block x."""
    syndrome = np.zeros(len(x), np.int64)
    for position in range(1, BLOCK + 1):
        syndrome ^= np.where(x >> (position - 1) & 1, position, 0)
    everyone = np.arange(len(x))
    exact, one = syndrome == 0, (syndrome > 0) & (syndrome <= BLOCK)
    index, found = [everyone[exact], everyone[one]], [x[exact], x[one] ^ (np.int64(1) << (syndrome[one] - 1))]
    for j in range(1, BLOCK + 1):
        k = syndrome ^ j
        pair = (k > j) & (k <= BLOCK)
        index.append(everyone[pair])
        found.append(x[pair] ^ (np.int64(1) << (j - 1)) ^ (np.int64(1) << (k[pair] - 1)))
    return np.concatenate(index), np.concatenate(found)


def first_cells(x: np.ndarray, y: np.ndarray, blocks: range) -> np.ndarray:
    """The smallest cell of ``blocks`` to which both of the fingerprints x and y (rows x prints) go; -1 where there is none."""
    found = np.full(len(x), -1, np.int64)
    for block in blocks:
        left = np.flatnonzero(found < 0)
        index, words = anchors(_bits_of(x[left], block))
        both = np.bitwise_count(words ^ _bits_of(y[left], block)[index]) <= 2
        low = np.full(len(left), np.iinfo(np.int64).max)
        np.minimum.at(low, index[both], words[both] | block << BLOCK)
        met = low < np.iinfo(np.int64).max
        found[left[met]] = low[met]
    return found


def _to_anchors(prints: int, blocks: range):
    names = ["cell", "node", "part_of", *(f"f{k}" for k in range(prints))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                part = batch.slice(i, 20_000)
                fps = np.stack([part.column(2 + k).to_numpy().view(np.uint64) for k in range(prints)], axis=1)
                for block in blocks:
                    index, words = anchors(_bits_of(fps, block))
                    rows = part.take(pa.array(index))
                    yield pa.RecordBatch.from_arrays([pa.array(words | block << BLOCK), *rows.columns], names)

    return run


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indexes of the edges a-b of a spanning forest of least weight; of equal weights the earlier edge goes first."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(weight, kind="stable")
    x, y = ends[: len(a)][order], ends[len(a) :][order]
    rank, label, kept = np.arange(len(order)), np.arange(len(nodes)), []
    while True:
        apart = label[x] != label[y]
        x, y, rank = x[apart], y[apart], rank[apart]
        if not len(x):
            return np.sort(order[np.concatenate(kept)]) if kept else np.empty(0, np.int64)
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, label[x], rank)
        np.minimum.at(best, label[y], rank)
        chosen = np.unique(best[best < len(order)])
        kept.append(chosen)
        at = np.searchsorted(rank, chosen)
        moved, root = contract(label[x[at]], label[y[at]])
        to = np.arange(len(nodes))
        to[moved] = root
        label = to[label]


def _compare(prints: int, threshold: int, every: bool, blocks: range):
    """Rows come sorted by (cell, part); a group that may go on in the next batch waits for it. All candidates between different parts leave, or a forest of them.

    Two near copies meet in many cells; they are a candidate in the first of them only.
    """

    def candidates(cell, side, node, part_of, fps, starts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ends = np.append(starts[1:], len(node))
        after = np.repeat(ends, ends - starts) - np.arange(len(node)) - 1  # rows of the group that follow each row
        upto = np.cumsum(after)
        done = 0
        while done < len(node):
            base = upto[done - 1] if done else 0
            end = max(done + 1, int(np.searchsorted(upto, base + _PAIRS_AT_ONCE, "right")))
            n = after[done:end]
            a = np.repeat(np.arange(done, end), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            bits = sum(np.bitwise_count(fps[a, k] ^ fps[b, k]).astype(np.int16) for k in range(prints))
            near = (bits <= threshold) & ((side[a] == _BOTH) | (side[a] != side[b])) & (part_of[a] != part_of[b])
            a, b, bits = a[near], b[near], bits[near]
            once = first_cells(fps[a], fps[b], blocks) == cell[a]
            a, b = a[once], b[once]
            yield node[a], node[b], bits[once], part_of[a], part_of[b]
            done = end

    def linked(*rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple] = []
        for found in candidates(*rows):
            if every:
                if len(found[0]):
                    yield found[0], found[1]
                continue
            held.append(found)
            if sum(len(x[0]) for x in held) > _PAIRS_AT_ONCE:
                held = [_thinned(held)]
        if held:
            yield _thinned(held)[:2]

    def _thinned(held: list[tuple]) -> tuple[np.ndarray, ...]:
        found = [np.concatenate(x) for x in zip(*held)]
        stay = forest(found[3], found[4], found[2])  # parts are what the forest connects
        return tuple(x[stay] for x in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def new_groups(rows: pa.RecordBatch) -> np.ndarray:
            """Whether a row is of another group than the one before it; true for the first."""
            cell, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            return np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])

        def compared(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.concat_batches(parts)
            fps = np.stack([rows.column(5 + k).to_numpy().view(np.uint64) for k in range(prints)], axis=1)
            for x, y in linked(*(rows.column(k).to_numpy() for k in (0, 2, 3, 4)), fps, np.flatnonzero(new_groups(rows))):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(np.flatnonzero(new_groups(batch))[-1])
            if last == 0 and waiting and not new_groups(pa.concat_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)]))[1]:
                waiting.append(batch)
                continue
            if waiting or last:
                yield from compared([*waiting, batch.slice(0, last)])
            waiting = [batch.slice(last)]
        if waiting:
            yield from compared(waiting)

    return run


def candidates(fps: DataFrame, prints: int, threshold: int, cell_limit: int = 4096, every: bool = False, blocks: range | None = None) -> DataFrame:
    """Pairs (u, v), u < v, each once, between nodes of ``fps`` (node, part_of, f0, f1, ...) of different parts: all that meet at an anchor and differ in few bits, or so many as connect what all connect."""
    columns = [f"f{k}" for k in range(prints)]
    schema = "cell long, node long, part_of long, " + ", ".join(f"{c} long" for c in columns)
    cells_of = blocks or range(64 * prints // BLOCK)
    dealt = fps.select("node", "part_of", *columns).mapInArrow(_to_anchors(prints, cells_of), schema)
    heavy = dealt.groupBy("cell").count().where(F.col("count") > cell_limit)
    heavy = stored(heavy.select("cell", F.ceil(F.col("count") / cell_limit).alias("blocks")), "heavy-anchors")
    if heavy.isEmpty():
        dealt = dealt.withColumns({"part": F.lit(0).cast("long"), "side": F.lit(_BOTH)})
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        mine = F.pmod(F.xxhash64("node"), blocks)
        side = lambda i: F.when(mine < i, F.lit(_LEFT)).when(mine > i, F.lit(_RIGHT)).otherwise(F.lit(_BOTH))
        meets = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda i: F.struct((F.least(mine, i) * blocks + F.greatest(mine, i)).alias("part"), side(i).alias("side")))
        dealt = dealt.join(heavy, "cell", "left").select("cell", F.explode(meets).alias("meet"), "node", "part_of", *columns).select("cell", "meet.part", "meet.side", "node", "part_of", *columns)
    ordered = dealt.select("cell", "part", "side", "node", "part_of", *columns).repartition("cell", "part").sortWithinPartitions("cell", "part")
    return ordered.mapInArrow(_compare(prints, threshold, every, cells_of), "u long, v long")


def checked(pairs: DataFrame, rows: DataFrame, sets: DataFrame, words: int, similarity: float, at_once: int = 256) -> DataFrame:
    """(u, v, linked): the pairs (u, v) with whether their sets of shingles are as alike as ``similarity``.

    ``rows`` (id, text) are the texts and ``sets`` (node, first_id) tells whose text a node's is. Both sets of a pair meet at the
    end with more pairs, in blocks of ``at_once``, so that a set that thousands are compared to is sent once a block, not once a pair.
    """
    degree = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    degree = stored(degree, "degrees")
    needed = sets.join(degree.select("node"), "node", "left_semi").select("node", "s0", "s1", F.col("first_id").alias("id"))
    shingles = rows.join(needed, "id").select("node", "s0", "s1", "text").mapInArrow(_shingles(words), "node long, set array<long>")
    shingles = stored(shingles.groupBy("node").agg(F.first("set").alias("set")), "shingles")
    of = lambda end: degree.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"))
    ends = pairs.join(of("u"), "u").join(of("v"), "v")
    more = F.col("n_u") >= F.col("n_v")
    ends = ends.select("u", "v", F.when(more, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(more, F.col("v")).otherwise(F.col("u")).alias("leaf"), F.greatest("n_u", "n_v").alias("n"))
    blocks = lambda n: F.ceil(n / at_once)
    leaves = ends.join(shingles.withColumnsRenamed({"node": "leaf", "set": "set_b"}), "leaf").withColumn("block", F.pmod(F.xxhash64("leaf"), blocks(F.col("n"))))
    hubs = shingles.join(degree, "node").select(F.col("node").alias("hub"), F.col("set").alias("set_a"), F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col("n")) - 1)).alias("block"))
    met = leaves.join(hubs.hint("merge"), ["hub", "block"])
    common = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - common
    return met.select("u", "v", F.coalesce(common / either >= similarity, F.lit(True)).alias("linked"))


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    prints: int = 3,
    cell_limit: int = 4096,
) -> DataFrame:
    """(id, component_id), one row per row of ``docs``: the smallest id that checked links reach, the document's own included. Ids are of any type that has an order, and aren't null.

    Defined cases: null and empty texts have no shingles and link to
    each other only; a text of fewer than ``words`` words is one shingle; repeated rows each give a row;
    an empty table gives no rows; texts are read whole; other columns are
    ignored.
    """
    key = [*(f"f{k}" for k in range(prints)), "s0", "s1"]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    made = rows.mapInArrow(_fingerprints(words, prints), StructType([StructField("id", rows.schema["id"].dataType), *(StructField(c, LongType()) for c in key)]))
    made = stored(made, "long-fingerprints")
    sets = made.groupBy(*key).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    sets = stored(sets.withColumn("node", F.monotonically_increasing_id()), "sets-of-shingles")
    bits, prints_of = most_bits(similarity, prints), key[:prints]
    fps = sets.where((F.col("s0") != 0) | (F.col("s1") != 0)).select("node", *prints_of)
    # Of sets that share a fingerprint one goes to the anchors, and is compared to the others.
    alike = stored(fps.groupBy(*prints_of).agg(F.min("node").alias("part_of"), F.count(F.lit(1)).alias("n")), "fingerprints-of-sets")
    beside = looked_up(fps, alike, prints_of, "n").where("node != part_of").select(F.col("part_of").alias("u"), F.col("node").alias("v"))
    first = alike.select(F.col("part_of").alias("node"), "part_of", *prints_of)

    # The anchors of one block first: what they link needs no more pairs at the others'.
    pairs = stored(candidates(first, prints, bits, cell_limit, blocks=range(1)).unionByName(beside), "candidates")
    links = stored(checked(pairs, rows, sets, words, similarity), "checked")
    found = components(links.where("linked").select("u", "v"))
    left = stored(first.drop("part_of").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("part_of"), *prints_of), "nodes-of-parts")
    others = candidates(left, prints, bits, cell_limit, blocks=range(1, 64 * prints // BLOCK))
    others = stored(others.join(pairs, ["u", "v"], "left_anti"), "candidates")
    links = stored(links.unionByName(checked(others, rows, sets, words, similarity)), "checked")
    pairs = pairs.unionByName(others)
    found = stored(components(links.where("linked").select("u", "v")), "groups")
    # What candidates connect and links don't: there all candidates between parts are checked.
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    root = lambda of, name: of.select("node", F.col("root").alias(name))
    both = nodes.join(root(components(pairs), "wide"), "node", "left").join(root(found, "part_of"), "node", "left")
    both = stored(both.select("node", F.coalesce("wide", "node").alias("wide"), F.coalesce("part_of", "node").alias("part_of")), "parts")
    parted = both.groupBy("wide").agg(F.min("part_of").alias("low"), F.max("part_of").alias("high")).where("low != high").select("wide")
    again = stored(both.join(parted, "wide", "left_semi").select("node", "part_of"), "parted")
    if not again.isEmpty():
        rest = candidates(fps.join(again, "node"), prints, bits, cell_limit, every=True)
        rest = stored(rest.join(links, ["u", "v"], "left_anti"), "more-candidates")
        more = checked(rest, rows, sets, words, similarity)
        found = components(links.unionByName(more).where("linked").select("u", "v"))

    named = sets.join(found, "node", "left").select(*key, "first_id", "n", F.coalesce("root", "node").alias("root"))
    named = stored(named, "named-sets")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("of"))
    named = looked_up(named, names, ["root"], "of").select(*key, "n", "component_id")
    return looked_up(made, named, key, "n").select(F.col("id").alias(id_col), "component_id")
