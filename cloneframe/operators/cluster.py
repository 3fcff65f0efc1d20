"""Hierarchical clustering of edge tables.

``agglomerate`` builds a linkage up to a height in Spark: in each round all pairs of clusters that are each other's nearest merge, and
distances between clusters are combined by aggregates over edges. For complete, average and Ward linkage this gives what merging one nearest pair
after the other gives (a merge never brings clusters nearer). Two clusters of which some pair has no edge are farther apart than the edges reach,
so they can't merge and their edges go: no part of the edges is gathered, and none is too large. Equal heights are taken in the order of a hash, so
that many pairs merge in a round. ``linkage`` is the same for one matrix in memory.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .ranks import ranked


def linkage(d: np.ndarray, method: str = "complete") -> np.ndarray:
    """Rows (a, b, height, size) of an agglomeration by nearest-neighbour chains, sorted by height. Methods: complete, average, single, ward."""
    n = len(d)
    d = d.astype(float).copy()
    if method == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    size, alive, chain, out = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            x = chain[-1]
            row = np.where(alive, d[x], np.inf)
            row[x] = np.inf
            y = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
                break
            chain.append(y)
        x, y = sorted((chain.pop(), chain.pop()))
        h, a, b = d[x, y], size[x], size[y]
        out.append((x, y, np.sqrt(h) if method == "ward" else h, a + b))
        if method == "complete":
            new = np.maximum(d[x], d[y])
        elif method == "single":
            new = np.minimum(d[x], d[y])
        elif method == "average":
            new = (a * d[x] + b * d[y]) / (a + b)
        elif method == "ward":
            new = ((a + size) * d[x] + (b + size) * d[y] - size * h) / (a + b + size)
        else:
            raise ValueError(f"no linkage {method!r}")
        d[x, :] = d[:, x] = new
        d[x, x] = np.inf
        size[x], alive[y] = a + b, False
    out.sort(key=lambda r: r[2])
    # Slots become node numbers: leaves 0..n-1, merges n, n + 1, ...
    name, rows = list(range(n)), []
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (x, y, h, s) in enumerate(out):
        x, y = find(x), find(y)
        rows.append((*sorted((name[x], name[y])), h, s))
        root[y] = x
        name[x] = n + k
    return np.array(rows, float).reshape(-1, 4)


def cut_tree(z: np.ndarray, n: int, t: float) -> np.ndarray:
    """A label 0.. for each leaf, of clusters whose merges are at most t."""
    root = list(range(2 * n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, b, h, _) in enumerate(z):
        if h <= t:
            root[find(int(a))] = root[find(int(b))] = n + k
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def parts_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ix, part): the smallest id that can be reached, by label propagation with pointer jumping until nothing changes. Edges run both ways."""
    edges = written(edges.select("left_ix", "right_ix"))
    labels = nodes.select("ix", F.col("ix").alias("part"))
    while True:
        near = edges.join(labels, edges["left_ix"] == labels["ix"]).groupBy(F.col("right_ix").alias("ix")).agg(F.min("part").alias("_p"))
        step = labels.join(near, "ix", "left").select("ix", F.col("part").alias("_old"), F.least("part", F.coalesce("_p", "part")).alias("_new"))
        jump = labels.select(F.col("ix").alias("_new"), F.col("part").alias("_far"))
        new = written(step.join(jump, "_new").select("ix", F.least("_new", "_far").alias("part"), "_old"))
        labels = new.select("ix", "part")
        if new.filter("part <> _old").isEmpty():
            return labels


def _combined(edges: DataFrame, merged: DataFrame, method: str) -> DataFrame:
    """Directed edges (u, v, d, nu, nv) after the merges (old, new, h, no, other) of their first ends; an edge that only one half of a merge has goes."""
    both = edges.join(merged.select(F.col("old").alias("u"), "new", "h", "other"), "u", "left").filter("new is null or v <> other")
    new, kept = F.coalesce("new", "u"), F.col("new").isNull()
    total = F.sum("nu")
    mean = F.sum(F.col("d") * F.col("nu")) / total
    # Ward: of squared heights, weighted by sizes, less the merge's own.
    ward = F.sqrt((F.sum((F.col("nu") + F.col("nv")) * F.col("d") * F.col("d")) - F.max("nv") * F.max("h") * F.max("h")) / (total + F.max("nv")))
    d = {"complete": F.max("d"), "average": mean, "ward": F.coalesce(ward, F.max("d"))}[method]
    out = both.groupBy(new.alias("u"), "v").agg(d.alias("d"), total.cast("long").alias("nu"), F.max("nv").alias("nv"), F.count("*").alias("_k"), F.max(kept).alias("_kept"))
    return out.filter("_kept or _k = 2").select("u", "v", "d", "nu", "nv")


def agglomerate(edges: DataFrame, nodes: DataFrame, t: float, method: str = "complete", node_id: str = "clone_ix") -> tuple[DataFrame, DataFrame]:
    """((ix, cluster_id), (node, ix, height)): clusters cut at t, named by their smallest member, and all members of each merge on the way.

    ``edges`` (left_ix, right_ix, dist) run both ways and hold all pairs within what t needs: for complete linkage those within t. A node is
    "round:cluster". Methods: complete, average, ward; single linkage at t is ``parts_of``.
    """
    if method not in ("complete", "average", "ward"):
        raise ValueError(f"no linkage {method!r}")
    labels = nodes.select(F.col(node_id).alias("ix"), F.col(node_id).alias("cluster_id")).distinct()
    one = F.lit(1).cast("long")
    pairs = edges.filter("left_ix <> right_ix").select(F.col("left_ix").alias("u"), F.col("right_ix").alias("v"), F.col("dist").cast("double").alias("d"), one.alias("nu"), one.alias("nv"))
    # A complete linkage never brings a pair nearer, so what is beyond t is of no use.
    live = written((pairs.filter(F.col("d") <= t) if method == "complete" else pairs).distinct())
    members, turn = None, 0
    while True:
        key = F.struct("d", F.xxhash64(F.least("u", "v"), F.greatest("u", "v")).alias("o"), "v", "nv")
        nearest = live.filter(F.col("d") <= t).groupBy("u").agg(F.min(key).alias("k"), F.first("nu").alias("n"))
        first = nearest.select(F.col("u").alias("a"), F.col("k.v").alias("b"), F.col("k.d").alias("h"), F.col("n").alias("na"))
        second = nearest.select(F.col("u").alias("b"), F.col("k.v").alias("a"), F.col("n").alias("nb"))
        merges = written(first.join(second, ["a", "b"]).filter("a < b"))
        if merges.isEmpty():
            break
        turn += 1
        halves = merges.select(F.col("a").alias("old"), F.col("a").alias("new"), "h", F.col("b").alias("other")).union(merges.select(F.col("b").alias("old"), F.col("a").alias("new"), "h", F.col("a").alias("other")))
        halves = written(halves)
        once = _combined(live, halves, method).select(F.col("v").alias("u"), F.col("u").alias("v"), "d", F.col("nv").alias("nu"), F.col("nu").alias("nv"))
        live = written(_combined(once, halves, method))
        moved = labels.join(halves.select(F.col("old").alias("cluster_id"), "new", "h"), "cluster_id", "left")
        moved = written(moved.select("ix", F.coalesce("new", "cluster_id").alias("cluster_id"), "h"))
        labels = moved.select("ix", "cluster_id")
        held = moved.filter("h is not null").select(F.concat_ws(":", F.lit(turn), "cluster_id").alias("node"), "ix", F.col("h").alias("height"))
        members = held if members is None else members.union(held)
    if members is None:
        members = labels.filter("false").select(F.lit("").alias("node"), "ix", F.lit(0.0).alias("height"))
    return labels, members


def hierarchical(edges: DataFrame, nodes: DataFrame, t: float, method: str = "complete", node_id: str = "clone_ix") -> DataFrame:
    """(ix, cluster_id): clusters of a linkage cut at t, named by their smallest member's id. Pairs without an edge are beyond all heights."""
    if method == "single":
        ids = nodes.select(F.col(node_id).alias("ix")).distinct()
        return parts_of(edges.filter(F.col("dist") <= t), ids).select("ix", F.col("part").alias("cluster_id"))
    return agglomerate(edges, nodes, t, method, node_id)[0]


def clusters_of(assigned: DataFrame) -> DataFrame:
    """(cluster_id, members, size, rank): largest first, ties by id. A cluster's members are one row; ``assigned`` is the same without gathering."""
    out = assigned.groupBy("cluster_id").agg(F.sort_array(F.collect_list("ix")).alias("members"), F.count("*").alias("size"))
    return ranked(out, [F.desc("size"), "cluster_id"])
