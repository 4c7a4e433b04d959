"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at 3 or fewer differing bits. Then at least one
of the two 32-bit halves differs in at most one bit. 31 bits of a half are
covered by the perfect [31, 26] Hamming code: every word is within R = 1 of
exactly one code word, its *home* anchor. If x and y differ there in t <= 1
bits, x's home is within R + t = 2 of y. So each distinct fingerprint goes
once to its home in either half, and as a probe to every anchor within 2 of it
(16 in either half at most); homes and probes are compared per anchor. No
link can be missed, and random fingerprints meet with chance 2^-22 a half.

Skew: copies share a fingerprint and are merged before (map-side) they are
dealt out; what a task compares it contracts to star edges, so a group of n
near copies gives about n rows, not n^2; an anchor with more than
``cell_limit`` homes is split into blocks of homes x blocks of probes that
go to different tasks. Components come from star contraction (large-star,
small-star) over written tables, and never pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored, text_of

SEED = 42
THRESHOLD = 3
_PAIRS_AT_ONCE = 1 << 21
#: A node of more than one in so many edges is a hub.
HOT_SHARE = 10_000


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of UTF-8 ``text``: A-Z lower-cased, words cut at [\\x20\\x09-\\x0D]."""
    w = text.lower().split()  # on bytes both touch ASCII only
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [digest(b" ".join(w), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)))]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = np.unpackbits(h[i : i + 65536].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(words), "id long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        s |= (np.bitwise_count(x & np.int64(mask)).astype(np.int64) & 1) << k
    return s


def _flip(x: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Position 0 stands for no bit."""
    return np.where(position > 0, x ^ (np.int64(1) << np.maximum(position - 1, 0)), x)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, cell, probe?) of every home and probe. A cell is half << 31 | code word."""
    index, cells, probe = [], [], []
    for half in (0, 1):
        x = (fps.view(np.uint64) >> np.uint64(32 * half)).astype(np.int64) & 0x7FFFFFFF
        s = _syndrome(x)
        everyone = np.arange(len(x))
        home = _flip(x, s)
        found = [(everyone, home, False), (everyone, home, True)]
        off = s > 0
        xo, so, eo = x[off], s[off], everyone[off]
        for j in range(1, 32):
            k = so ^ j
            pair = (k > j) & (k > 0)  # so == j would leave k = 0: that anchor is the home
            found.append((eo[pair], _flip(_flip(xo[pair], np.full(pair.sum(), j)), k[pair]), True))
        for i, a, p in found:
            index.append(i)
            cells.append(a | (half << 31))
            probe.append(np.full(len(i), p))
    return np.concatenate(index), np.concatenate(cells), np.concatenate(probe)


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for i in range(0, len(fps), 20_000):
            part = fps[i : i + 20_000]
            index, cells, probe = anchors(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), pa.array(probe), pa.array(part[index])], ["cell", "probe", "fp"]
            )


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph with edges a-b; roots are left out."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cell, part, probe): the homes of a cell, then its probes. Homes of a cell that is not over are carried on."""
    carried: tuple | None = None
    for batch in batches:
        cell, part, probe, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if carried is not None:
            cell, part, probe, fp = (np.concatenate(x) for x in zip(carried, (cell, part, probe, fp)))
        if not len(fp):
            continue
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        homes = np.add.reduceat(~probe, starts)
        last = slice(starts[-1], starts[-1] + homes[-1])
        carried = (cell[last], part[last], probe[last], fp[last])
        rows = np.flatnonzero(probe & (homes[group] > 0))
        ends = np.cumsum(homes[group[rows]])
        left, right = [], []
        done = 0
        while done < len(rows):
            base = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + _PAIRS_AT_ONCE, "right")))
            some = rows[done:upto]
            n = homes[group[some]]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = fp[np.repeat(some, n)]
            b = fp[np.repeat(starts[group[some]], n) + offset]
            near = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= THRESHOLD)
            left.append(a[near])
            right.append(b[near])
            if sum(map(len, left)) > _PAIRS_AT_ONCE:
                x, y = contract(np.concatenate(left), np.concatenate(right))
                left, right = [x], [y]
            done = upto
        if left:
            x, y = contract(np.concatenate(left), np.concatenate(right))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])


def links(fps: DataFrame, cell_limit: int = 4096) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of ``fps`` (fp) with the components that all links have."""
    dealt = fps.select("fp").mapInArrow(_to_anchors, "cell long, probe boolean, fp long")
    homes = dealt.where("not probe").groupBy("cell").count().where(F.col("count") > cell_limit)
    heavy = stored(homes.select("cell", F.ceil(F.col("count") / cell_limit).alias("blocks")), "heavy-anchors")
    if heavy.isEmpty():
        dealt = dealt.withColumn("part", F.lit(0).cast("long"))
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        mine = F.pmod(F.xxhash64("fp"), blocks)
        # A home meets every block of probes and a probe every block of homes.
        many = F.sequence(F.lit(0).cast("long"), blocks - 1)
        part = F.transform(many, lambda i: F.when(F.col("probe"), i * blocks + mine).otherwise(mine * blocks + i))
        dealt = dealt.join(heavy, "cell", "left").select("cell", F.explode(part).alias("part"), "probe", "fp")
    ordered = dealt.select("cell", "part", "probe", "fp").repartition("cell", "part")
    return ordered.sortWithinPartitions("cell", "part", "probe").mapInArrow(_compare, "u long, v long")


def _with_low(rows: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, ...) with each u's ``m`` of ``low`` (u, m, degree). Hubs, of which there are fewer than 2 x HOT_SHARE among n edges, are broadcast."""
    floor = max(1, n // HOT_SHARE)
    hubs = F.broadcast(low.where(F.col("degree") > floor).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(low.where(F.col("degree") <= floor).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], n: str) -> DataFrame:
    """``rows`` joined to ``table``, each of whose rows says in ``n`` how many of ``rows`` ask for it.

    Those that more than one in HOT_SHARE of all ask for are fewer than HOT_SHARE: they are broadcast, so that no key is one task's.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(n) > max(1, total // HOT_SHARE)).drop(n))
    others = rows.join(hot.select(*on), on, "left_anti").join(table.drop(n), on)
    return rows.join(hot, on).unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with an edge other than roots.

    Large-star and small-star in turn, each round a written table; rounds
    grow with the logarithm of a component's size. A node of very many edges,
    as each large component's root comes to be, is no one task's.
    """
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, n = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        low = stored(low, "neighbours")
        large = _with_low(both.where("v > u"), low, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u != v").distinct(), "large-star")
        # Here u is the larger end, so that no node is a hub: it has a few smaller neighbours.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        edges = stored(small.where("u != v").distinct(), "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = state, state[0]


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, cell_limit: int = 4096
) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest id among the documents that links of at
    most 3 differing bits reach, the document itself included.

    Defined cases: a null or empty text has fingerprint zero and is linked
    like any other; a text of fewer than ``words`` words is one shingle;
    repeated rows each give a row; null ids take part, are never a
    component's name unless all its ids are null; an empty table gives no
    rows; texts are read whole; other columns are ignored.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = components(links(fps, cell_limit))
    named = fps.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", "n", F.coalesce("root", "fp").alias("root")
    )
    named = stored(named, "named-fingerprints")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("of"))
    named = looked_up(named, names, ["root"], "of").select("fp", "n", "component_id")
    return looked_up(rows, named, ["fp"], "n").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
