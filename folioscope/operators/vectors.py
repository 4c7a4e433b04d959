"""Vector operators: neighbours, exact by blocks or of the candidates that a coarse quantiser proposes, maps, clusters, carry-over.

Vectors come as rows (item_id, vector array<float>).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.graphs import cut
from folioscope.operators.ranking import ranked

#: Rows of one block of the similarity join: two blocks and their product are what a task holds.
BLOCK = 4096
#: Values of a block's vectors at most where blocks are larger than that, and cells of a product that a task holds at once.
_LARGE, _CELLS = 1 << 23, 1 << 22


def normalised(vectors: DataFrame) -> DataFrame:
    """(item_id, vector, hash) of length 1; a zero vector is an error, as a model never gives one."""
    wide = vectors.select("item_id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    rows = wide.withColumn("n", norm)
    safe = F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.raise_error(F.lit("zero vector")))
    text = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    return rows.select("item_id", safe.alias("vector"), F.sha2(text, 256).alias("hash"))


def _best(pdf: pd.DataFrame, other: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of ``other`` for each row, by score, then id; different ids are different vectors."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(pdf) and len(other):
        other = other.sort_values("item_id")
        mine, ids, b = pdf["item_id"].to_numpy(), other["item_id"].to_numpy(), np.stack(other["vector"].to_numpy())
        for rows in strips(len(pdf), len(other)):
            score = np.round(np.stack(pdf["vector"].to_numpy()[rows]) @ b.T, 6)
            score[mine[rows][:, None] == ids[None, :]] = -np.inf
            # All that tie with the k-th stay in until ids decide.
            least = np.partition(score, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(score), -np.inf)
            r, c = np.nonzero((score >= least[:, None]) & (score > 0))
            order = np.lexsort((c, -score[r, c], r))
            r, c = r[order], c[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c = r[keep], c[keep]
            out.append((mine[rows][r], ids[c], score[r, c]))
    return pd.DataFrame(dict(zip(("src", "dst", "score"), map(np.concatenate, zip(*out)))))


def strips(rows: int, others: int) -> Iterator[slice]:
    """Slices of rows whose products with ``others`` are some 32 MB."""
    at_once = max(1, _CELLS // max(1, others))
    return (slice(i, i + at_once) for i in range(0, rows, at_once))


def block_count(n: int, width: int, block: int, tasks: int) -> int:
    """Blocks of one side: of ``block`` rows while that keeps about ``tasks`` pairs of blocks busy; beyond that they grow up to _LARGE values, so that copies of a row don't grow with the table."""
    return max(1, -(-n // max(block, _LARGE // max(1, width))), min(-(-n // block), math.ceil(math.sqrt(tasks))))


def blocked(left: DataFrame, right: DataFrame, block: int = BLOCK):
    """Rows (item_id, vector, hash) of the two sides, cogrouped so that each pair of blocks is one task."""
    tasks = 3 * left.sparkSession.sparkContext.defaultParallelism
    sizes = [side.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first() for side in (left, right)]
    a, b = (block_count(n, width or 1, block, tasks) for n, width in sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    at = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    # Fresh columns: a cogroup of a table with itself can't tell the sides' columns apart otherwise.
    names = [c for c in ("item_id", "vector", "hash") if c in left.columns]
    fresh = [F.col(c).alias(c) for c in ("item_id", "vector", "hash") if c in right.columns]
    left = left.select(*names, at(a).alias("mine"), every(b).alias("theirs"))
    right = right.select(*fresh, every(a).alias("mine"), at(b).alias("theirs"))
    return left.groupBy("mine", "theirs").cogroup(right.groupBy("mine", "theirs"))


def different(rows: DataFrame) -> DataFrame:
    """One row (item_id, vector, hash) for each vector: that with the smallest id."""
    return rows.groupBy("hash").agg(F.min_by(F.struct("item_id", "vector"), "item_id").alias("_r")).select("_r.item_id", "_r.vector", "hash")


def of_equals(near: DataFrame, rows: DataFrame) -> DataFrame:
    """Neighbours of different() rows as those of all rows (item_id, hash)."""
    first = rows.groupBy("hash").agg(F.min("item_id").alias("src"))
    members = rows.select("hash", "item_id").join(first, "hash").select("src", "item_id")
    return near.join(members, "src").select(F.col("item_id").alias("src"), "dst", "score", "rank")


def similar_items(vectors: DataFrame, low_signal: DataFrame | None = None, top: int = 12, block: int = BLOCK) -> DataFrame:
    """(src, dst, score, rank): exact cosine neighbours above 0 by the rounded score, then id; no equal vectors, one per vector.

    Equal vectors have the same neighbours and only the first of them is one, so one row stands
    for each. Those are cut into blocks, and each pair of blocks is one task's
    matrix product, of which the best ``top`` of each row leave it; every row is copied once per block of the other side.
    """
    rows = normalised(vectors)
    if low_signal is not None:
        rows = rows.join(low_signal.select("item_id"), "item_id", "left_anti")
    rows = cut(rows)
    one = cut(different(rows).drop("hash"))
    near = blocked(one, one, block).applyInPandas(lambda a, b: _best(a, b, top), "src long, dst long, score double")
    return of_equals(ranked(near, ["src"], [F.desc("score"), F.col("dst").asc()], top), rows)


def centroids(rows: DataFrame, lists: int, seed: int = 42, most: int = 100_000) -> np.ndarray:
    """(lists x dimensions): directions that k-means finds in about ``most`` vectors of ``rows`` (item_id, vector, hash), chosen by their hash; the fit is all that is sampled."""
    n = rows.count()
    some = rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(seed), "hash"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    found = np.array(KMeans(k=lists, seed=seed, maxIter=8, distanceMeasure="cosine").fit(_as_ml(some)).clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _nearest_lists(directions: np.ndarray, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.array(batch.column(1).to_pylist(), float).reshape(-1, directions.shape[1])
            most = min(of, len(directions))
            near = np.argpartition(-(vectors @ directions.T), most - 1, axis=1)[:, :most] if len(vectors) else np.empty((0, most), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], ["item_id", "vector", "hash", "lists"])

    return run


def near_items(vectors: DataFrame, lists: int | None = None, homes: int = 3, probes: int = 16, top: int = 12, block: int = BLOCK) -> DataFrame:
    """(src, dst, score, rank) as similar_items() gives them, of candidates that a coarse quantiser proposes.

    Every vector is in the ``homes`` lists whose centroids are nearest, and
    is compared, by exact cosine, with all vectors of its ``probes`` nearest lists. Lists are about
    the square root of the vectors, so that work grows with the power 1.5, not with the square; a list is cut into
    blocks by its size, so that no direction is one task's, and blocks without a shared list never meet. README has the recall.
    """
    every_row = cut(normalised(vectors))
    rows = cut(different(every_row))
    n = rows.count()
    if n == 0:
        return similar_items(vectors, top=top)
    directions = centroids(rows, lists or max(1, min(4096, round(n**0.5))))
    names = "item_id long, vector array<double>, hash string, lists array<int>"
    told = cut(rows.select("item_id", "vector", "hash").mapInArrow(_nearest_lists(directions, homes), names))
    asked = cut(rows.select("item_id", "vector", "hash").mapInArrow(_nearest_lists(directions, probes), names))
    size = lambda df, name: df.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    blocks = size(asked, "a").join(size(told, "b"), "list")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    at = lambda k: F.pmod(F.xxhash64("item_id"), F.col(k))
    sides = [df.select("item_id", "vector", "hash", F.explode("lists").alias("list")).join(blocks, "list") for df in (asked, told)]
    left = sides[0].select("list", at("a").alias("mine"), "b", "item_id", "vector", "hash").select("list", "mine", every("b").alias("theirs"), "item_id", "vector", "hash")
    right = sides[1].select("list", at("b").alias("theirs"), "a", *[F.col(c).alias(c) for c in ("item_id", "vector", "hash")]).select("list", every("a").alias("mine"), "theirs", "item_id", "vector", "hash")
    keys = ["list", "mine", "theirs"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda x, y: _best(x, y, top), "src long, dst long, score double")
    near = near.groupBy("src", "dst").agg(F.max("score").alias("score"))
    return of_equals(ranked(near, ["src"], [F.desc("score"), F.col("dst").asc()], top), every_row)


def mean_vectors(rows: DataFrame, group: str) -> DataFrame:
    """(group, vector): mean of the vectors of each group, of length 1 again."""
    at = rows.select(group, F.posexplode("vector").alias("k", "x"))
    mean = at.groupBy(group, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    wide = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("vector"))
    return normalised(wide.withColumnRenamed(group, "item_id")).select(F.col("item_id").alias(group), "vector")


def _as_ml(vectors: DataFrame) -> DataFrame:
    return vectors.select("item_id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))


def layout(vectors: DataFrame) -> DataFrame:
    """(item_id, x, y) in [0, 1]: first two principal components, a linear stand-in for a neighbour embedding."""
    features = _as_ml(normalised(vectors))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(features)
    flat = model.transform(features).select("item_id", vector_to_array("p").alias("p")).select("item_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    box = flat.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: F.round((F.col(c) - F.col(f"lo_{c}")) / F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-12)), 6)
    return flat.join(F.broadcast(box)).select("item_id", scaled("x").alias("x"), scaled("y").alias("y"))  # box is one row


def cluster_count(n: int) -> int:
    """Root of half the rows, between 2 and 30."""
    return max(1, min(n, max(2, min(30, round((n / 2) ** 0.5)))))


def clusters(vectors: DataFrame, seed: int = 42) -> DataFrame:
    """(item_id, cluster) by k-means, numbered from 1 by size, then smallest item."""
    features = _as_ml(normalised(vectors))
    n = features.count()
    found = KMeans(k=cluster_count(n), seed=seed, featuresCol="features", predictionCol="c").fit(features).transform(features)
    size = found.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"))
    names = ranked(size, [], [F.desc("n"), F.col("first").asc()]).select("c", F.col("rank").cast("int").alias("cluster"))
    return found.join(names, "c").select("item_id", "cluster")


def similarity_groups(rows: DataFrame, top: int = 8, least: int = 3) -> DataFrame:
    """(item_id, panel): the ``top`` largest labels, "Other", and "" for none, of rows (item_id, label); nothing under ``least`` rows."""
    counts = rows.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    best = ranked(counts, [], [F.desc("n"), F.col("label").asc()], top).select("label", F.lit(True).alias("shown"))
    total = rows.agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least)
    out = rows.join(best, "label", "left").join(F.broadcast(total))  # one row, or none
    panel = F.when(F.col("label").isNull(), "").when(F.col("shown"), F.col("label").cast("string")).otherwise("Other")
    return out.select("item_id", panel.alias("panel"))


def quality(neighbours: DataFrame, kinds: DataFrame) -> DataFrame:
    """(sources, cross, mean_score): sources with neighbours, those with one of another kind (item_id, kind), mean score."""
    a = kinds.select(F.col("item_id").alias("src"), F.col("kind").alias("ka"))
    b = kinds.select(F.col("item_id").alias("dst"), F.col("kind").alias("kb"))
    rows = neighbours.join(a, "src").join(b, "dst")
    per = rows.groupBy("src").agg(F.max(F.col("ka") != F.col("kb")).alias("cross"), F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("sources"), F.count_if("cross").alias("cross"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_score"))


def with_percentile(neighbours: DataFrame) -> DataFrame:
    """Adds ``percentile``: the share of all pair scores that are lower, from counts per distinct score."""
    counts = neighbours.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    lower = F.coalesce(F.sum("c").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = counts.select("score", F.round(lower / F.sum("c").over(Window.partitionBy(F.lit(1))), 6).alias("percentile"))
    return neighbours.join(share, "score")


def restricted(neighbours: DataFrame, public: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """Neighbours between public items (item_id) that haven't been hidden since, ranks closed up."""
    rows = neighbours
    for side in ("src", "dst"):
        rows = rows.join(public.select(F.col("item_id").alias(side)), side, "left_semi")
        if hidden is not None:
            rows = rows.join(hidden.select(F.col("item_id").alias(side)), side, "left_anti")
    return ranked(rows.withColumnRenamed("rank", "_r"), ["src"], [F.col("_r").asc()]).drop("_r")


def rank_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, common, share): how much of a's neighbours are b's."""
    both = a.select("src", "dst").join(b.select("src", "dst"), ["src", "dst"]).groupBy("src").agg(F.count(F.lit(1)).alias("common"))
    size = a.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    rows = size.join(both, "src", "left").fillna({"common": 0})
    return rows.select("src", "common", F.round(F.col("common") / F.col("n"), 6).alias("share"))
