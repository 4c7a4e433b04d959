"""Graph algorithms.

PageRank, components and connected top-N run on DataFrames of any size. Louvain, label
propagation and the force layout depend on the order in
which nodes are visited; they take one *shown* graph, capped by its builder,
per group of ``applyInPandas``, and many groups run side by side.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.repulsion import exact_repulsion, repulsion

#: Most edges of one group that an order-dependent algorithm takes.
MAX_EDGES = 2_000_000
#: Half the width of a layout on the map in degrees, and half its height in Mercator radians.
LON_EXTENT, MERCATOR_EXTENT = 140.0, 2.2


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() where the session names a folder for it; else kept by executors, to be made again from lineage if lost."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions."""
    one = edges.select("a", "b", F.col("n").cast("double").alias("w"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def pagerank(edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """(node, rank) of a weighted undirected graph (a, b, n); ranks sum to 1.

    Every iteration is one join and one map-side combined sum over the
    edges; in a graph of edges in both directions each node gets something in each,
    so the list of nodes isn't joined again. The edges, and the ranks every few
    iterations, are cut from their lineage, so that lost executors cost the
    last few iterations only; then it is seen whether ranks still change by
    ``tolerance`` in all.
    """
    both = symmetric(edges)
    degree = both.groupBy("a").agg(F.sum("w").alias("degree"))
    flow = cut(both.join(degree, "a").select("a", "b", (F.col("w") / F.col("degree")).alias("share")))
    nodes = flow.select(F.col("a").alias("node")).distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(1, iterations + 1):
        before = ranks
        got = flow.join(ranks, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = got.select("node", (F.col("got") * alpha + (1 - alpha) / n).alias("rank"))
        if i % every == 0:
            ranks = cut(ranks)
            change = ranks.join(before.withColumnRenamed("rank", "was"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
            if change < tolerance:
                break
    total = ranks.agg(F.sum("rank").alias("total"))
    return ranks.join(F.broadcast(total)).select("node", (F.col("rank") / F.col("total")).alias("rank"))  # total is one row


def _adjacency(a, b, w) -> dict[int, dict[int, float]]:
    """Nodes in order of first appearance in edges sorted by (a, b)."""
    out: dict[int, dict[int, float]] = {}
    for x, y, n in sorted(zip(a, b, w)):
        out.setdefault(int(x), {})[int(y)] = float(n)
        out.setdefault(int(y), {})[int(x)] = float(n)
    return out


def louvain_level(graph: dict[int, dict[int, float]], passes: int = 50) -> dict[int, int]:
    """node -> community by local moves; a move needs a strictly larger gain w - (sum of degrees) k / 2m."""
    degree = {u: sum(w * (2 if u == v else 1) for v, w in near.items()) for u, near in graph.items()}
    double_m = sum(degree.values())
    community = {u: i for i, u in enumerate(graph)}
    inside = {community[u]: k for u, k in degree.items()}
    if not double_m:
        return community
    for _ in range(passes):
        moved = False
        for u, near in graph.items():
            to: dict[int, float] = defaultdict(float)
            for v, w in near.items():
                if v != u:
                    to[community[v]] += w
            home = community[u]
            inside[home] -= degree[u]
            gain = lambda c: to.get(c, 0.0) - inside[c] * degree[u] / double_m
            best, most = home, gain(home)
            for c in to:
                if gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            inside[best] += degree[u]
            if best != home:
                community[u], moved = best, True
        if not moved:
            break
    return community


def louvain(graph: dict[int, dict[int, float]], levels: int = 20) -> dict[int, int]:
    """Multilevel: communities become nodes, with loops for what is inside them."""
    label = {u: u for u in graph}
    for _ in range(levels):
        community = louvain_level(graph)
        if len(set(community.values())) == len(graph):
            break
        label = {u: community[c] for u, c in label.items()}
        small: dict[int, dict[int, float]] = {c: {} for c in dict.fromkeys(community.values())}
        for u, near in graph.items():
            for v, w in near.items():
                a, b = community[u], community[v]
                # Inner edges are met from both ends, loops once.
                small[a][b] = small[a].get(b, 0.0) + (w / 2 if a == b and u != v else w)
        graph = small
    return label


def by_size(label: dict[int, int], least: int = 1) -> dict[int, int]:
    """Communities numbered from 0 by size, then smallest node; those under ``least`` nodes become -1."""
    members: dict[int, list[int]] = defaultdict(list)
    for u, c in label.items():
        members[c].append(u)
    order = sorted(members.values(), key=lambda m: (-len(m), min(m)))
    return {u: (i if len(m) >= least else -1) for i, m in enumerate(order) for u in m}


def propagate(graph: dict[int, dict[int, float]], rounds: int = 20) -> dict[int, int]:
    """Asynchronous label propagation in sorted order; the lowest of equally common labels wins."""
    label = {u: u for u in graph}
    for _ in range(rounds):
        moved = False
        for u in sorted(graph):
            count: dict[int, int] = defaultdict(int)
            for v in graph[u]:
                count[label[v]] += 1
            if count:
                best = min(count, key=lambda c: (-count[c], c))
                if best != label[u]:
                    label[u], moved = best, True
        if not moved:
            break
    return label


def _grown(near: dict[int, list[tuple[float, int]]], starts: list[int], top: int) -> tuple[list[int], list[int]]:
    """Up to ``top`` nodes, best first, each next to one already taken; a new component starts only if two places are left.

    ``near`` has nodes' neighbours as (-score, node), ``starts`` the best nodes of all. Where the neighbours
    of a node taken aren't known yet it ends, and the second list names it and the best that wait with it.
    """
    import heapq

    taken: dict[int, None] = {}
    frontier: list[tuple[float, int]] = []
    at = 0
    while len(taken) < top:
        while frontier and frontier[0][1] in taken:
            heapq.heappop(frontier)
        if frontier:
            u = heapq.heappop(frontier)[1]
        else:
            while at < len(starts) and starts[at] in taken:
                at += 1
            if at == len(starts) or top - len(taken) < 2:
                break
            u = starts[at]
        taken[u] = None
        if u not in near:
            waiting = [v for _, v in sorted(set(frontier)) if v not in near and v not in taken]
            return list(taken), [u, *waiting[:top]]
        for step in near[u]:
            if step[1] not in taken:
                heapq.heappush(frontier, step)
    return list(taken), []


def connected_top(graph: dict[int, dict[int, float]], score: dict[int, float], top: int) -> list[int]:
    """_grown() of a graph at hand."""
    near = {u: [(-score[v], v) for v in to] for u, to in graph.items()}
    return _grown(near, sorted(graph, key=lambda u: (-score[u], u)), top)[0]


def force_layout(
    a: np.ndarray, b: np.ndarray, w: np.ndarray, nodes: np.ndarray, iterations: int | None = None,
    scaling: float = 10.0, gravity: float = 0.05, tree_from: int = 128,
) -> np.ndarray:
    """ForceAtlas2 positions in [-1, 1], centred, from a golden-angle spiral; each node has a speed of its own.

    Above ``tree_from`` nodes repulsion is by a Barnes-Hut tree, else exact.
    """
    n = len(nodes)
    if n < 2:
        return np.zeros((n, 2))
    iterations = iterations or (520 if n <= 300 else 400 if n <= 900 else 260)
    k = np.arange(n)
    radius, angle = 3 * np.sqrt(k + 1), k * math.pi * (3 - math.sqrt(5))
    at = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    mass = 1.0 + np.bincount(np.concatenate([x, y]), np.concatenate([w, w]), minlength=n)
    before, still = np.zeros_like(at), np.ones(n)
    for _ in range(iterations):
        force = scaling * (repulsion(at, mass) if n > tree_from else exact_repulsion(at, mass)) - gravity * mass[:, None] * at
        pull = (at[y] - at[x]) * w[:, None]
        for axis in (0, 1):
            force[:, axis] += np.bincount(x, pull[:, axis], minlength=n) - np.bincount(y, pull[:, axis], minlength=n)
        swing = 1 + np.sqrt(mass * np.linalg.norm(before - force, axis=1))
        traction = np.linalg.norm(before + force, axis=1) / 2
        speed = still * np.log1p(traction) / swing
        still = np.minimum(1.0, np.sqrt(speed * (force**2).sum(1) / swing))
        at = at + force * (speed / (1 + math.log(n)))[:, None]
        before = force
    low, high = at.min(0), at.max(0)
    return (at - (low + high) / 2) * 2 / (max((high - low).max(), 0.0) or 1.0)


def pseudo_coordinates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Layout as longitude and latitude, four digits, for a Mercator map."""
    lon = np.round(at[:, 0] * LON_EXTENT, 4)
    lat = np.round(np.degrees(np.arctan(np.sinh(at[:, 1] * MERCATOR_EXTENT))), 4)
    return lon, lat


def _grouped(edges: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """One call per key, or one for all edges; a graph of more than MAX_EDGES edges is refused, not cut."""

    def guarded(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_EDGES:
            raise ValueError(f"{len(pdf)} edges in one shown graph; cap it first")
        return run(pdf)

    rows = edges if keys else edges.withColumn("_all", F.lit(0))
    out = rows.groupBy(*(keys or ["_all"])).applyInPandas(guarded, schema)
    return out


def communities(edges: DataFrame, method: str = "louvain", least: int = 1, key: str | None = None) -> DataFrame:
    """([key,] node, community) by "one-level", "louvain" or "propagation"."""
    find = {"one-level": louvain_level, "louvain": louvain, "propagation": propagate}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = by_size(find(_adjacency(pdf["a"], pdf["b"], pdf["n"])), least)
        out = pd.DataFrame({"node": list(found), "community": list(found.values())}).astype("int64")
        if key:
            out.insert(0, key, pdf[key].iloc[0])
        return out

    return _grouped(edges, [key] if key else [], run, (f"{key} long, " if key else "") + "node long, community long")


def connected_top_n(edges: DataFrame, ranks: DataFrame, top: int) -> DataFrame:
    """(node, place) of the connected top of a graph (a, b, n) by ranks (node, rank) to nine digits, then node.

    Of a node's neighbours only its ``top`` best can be taken: any other comes after all of them. So
    those are kept, and those of the nodes that are reached are looked up, a few hundred at a time, until the top is known.
    """
    scored = ranks.select(F.col("node"), (-F.round("rank", 9)).alias("low"))
    both = symmetric(edges).select("a", "b").join(scored.withColumnRenamed("node", "b"), "b").join(scored.select(F.col("node").alias("a"), F.col("low").alias("own")), "a")
    best = Window.partitionBy("a").orderBy("low", "b")
    kept = cut(both.distinct().withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= top).select("a", "own", "b", "low"))
    starts = [r.a for r in kept.select("a", "own").distinct().orderBy("own", "a").limit(top).collect()]
    near: dict[int, list[tuple[float, int]]] = {}
    nodes, wanted = [], starts[:1]
    while wanted:
        near |= {u: [] for u in wanted}
        for r in kept.where(F.col("a").isin(wanted)).select("a", "low", "b").collect():  # top nodes of top neighbours
            near[r.a].append((r.low, r.b))
        nodes, wanted = _grown(near, starts, top)
    rows = [(u, k) for k, u in enumerate(nodes, 1)]
    return edges.sparkSession.createDataFrame(rows, "node long, place long")


def layout(edges: DataFrame, iterations: int | None = None) -> DataFrame:
    """(node, lon, lat)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        a, b, w = pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy(float)
        nodes = np.unique(np.concatenate([a, b]))
        lon, lat = pseudo_coordinates(force_layout(a, b, w / w.max(), nodes, iterations))
        return pd.DataFrame({"node": nodes, "lon": lon, "lat": lat})

    return _grouped(edges, [], run, "node long, lon double, lat double")


def unique_names(rows: DataFrame) -> DataFrame:
    """(item_id, title): titles that several items share get their id appended."""
    same = F.count(F.lit(1)).over(Window.partitionBy("title"))
    name = F.when(same > 1, F.concat("title", F.lit(" (#"), F.col("item_id").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return rows.withColumn("_name", name).select("item_id", F.col("_name").alias("title"))
