"""Hierarchical clustering into k clusters (M20): ward, complete, average, single.

* Ward, complete and average linkage work on clustering features (rows, sum,
  sum of squares).  Every task folds its rows into at most ``leaves`` of them, widening
  its radius only when they no longer fit; the tasks' leaves are merged eight
  sets at a time in the same way.  A nearest-neighbour chain with Lance-Williams
  updates then builds the tree over the leaves, and every row takes the cluster of its
  nearest leaf.  As long as there are no more than ``leaves`` different rows, every
  leaf is one of them and the result is that of all pairs.
* Single linkage is exact at any size.  The cut lies between a distance that leaves at
  least k components and one that leaves at most k; between them, the shortest edges
  that join components are found on the grid and taken in Borůvka rounds.

Clusters are numbered by their smallest id."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import neighbors as N
from .components import connected_components
from .running import running_sums

LINKAGES = ("ward", "complete", "average", "single")
#: Sets of leaves that one merging task reads.
MERGED = 8
#: Edges that one task brings into a forest.
LAST_EDGES = 500_000


# ------------------------------------------------------------ clustering features

class Leaves:
    """Clustering features that take rows in, at most ``most`` of them."""

    def __init__(self, dim: int, most: int):
        self.n, self.sum, self.sq = np.zeros(0), np.zeros((0, dim)), np.zeros(0)
        self.most, self.radius = most, 0.0

    def take(self, n: np.ndarray, total: np.ndarray, sq: np.ndarray) -> None:
        """Rows or other leaves; those within the radius of a centre join it."""
        rows, first, at = np.unique(total / n[:, None], axis=0, return_index=True, return_inverse=True)
        at = at.ravel()
        n, sq = np.bincount(at, n), np.bincount(at, sq)
        total = rows * n[:, None]
        if len(self.n):
            near, dist = _nearest(rows, self.sum / self.n[:, None])
            joins = dist <= self.radius
            np.add.at(self.n, near[joins], n[joins])
            np.add.at(self.sum, near[joins], total[joins])
            np.add.at(self.sq, near[joins], sq[joins])
            n, total, sq = n[~joins], total[~joins], sq[~joins]
        self.n, self.sum = np.concatenate([self.n, n]), np.concatenate([self.sum, total])
        self.sq = np.concatenate([self.sq, sq])
        while len(self.n) > self.most:
            self._widen()

    def _widen(self) -> None:
        """Double the radius, at least to what joins a fair part of the leaves, and fold them again."""
        centres = self.sum / self.n[:, None]
        dist = np.sqrt(np.maximum(_squares(centres, centres), 0))
        np.fill_diagonal(dist, np.inf)
        self.radius = max(2 * self.radius, float(np.quantile(dist.min(1), 0.5)))
        left, owner = np.ones(len(centres), bool), np.full(len(centres), -1)
        for i in range(len(centres)):
            if left[i]:
                mine = left & (dist[i] <= self.radius)
                mine[i] = True
                owner[mine], left = i, left & ~mine
        _, at = np.unique(owner, return_inverse=True)
        groups = at.max() + 1
        total = np.zeros((groups, self.sum.shape[1]))
        np.add.at(total, at, self.sum)
        self.n, self.sq, self.sum = np.bincount(at, self.n), np.bincount(at, self.sq), total

    def frame(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": part, "n": self.n, "total": list(self.sum), "sq": self.sq})


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance to it), by direct differences to the best one."""
    near = np.empty(len(rows), np.int64)
    for s in range(0, len(rows), 4096):
        near[s:s + 4096] = _squares(rows[s:s + 4096], centres).argmin(1)
    return near, np.sqrt(((rows - centres[near]) ** 2).sum(1))


LEAF = "part long, n double, total array<double>, sq double"


def leaf_table(points: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` clustering features of ``points`` (id, v), in the order of their centres."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = None
        for batch in batches:
            for s in range(0, len(batch), most):
                x = np.stack(batch["v"].iloc[s:s + most].to_numpy()).astype(float)
                leaves = leaves or Leaves(x.shape[1], most)
                leaves.take(np.ones(len(x)), x, (x * x).sum(1))
        if leaves is not None:
            yield leaves.frame(0)

    def merge(sets: pd.DataFrame) -> pd.DataFrame:
        leaves = Leaves(len(sets["total"].iloc[0]), most)
        for s in range(0, len(sets), most):
            part = sets.iloc[s:s + most]
            leaves.take(part["n"].to_numpy(), np.stack(part["total"].to_numpy()), part["sq"].to_numpy())
        return leaves.frame(int(sets["part"].iloc[0]))

    table = written(points.select("v").mapInPandas(fold, LEAF).withColumn("part", F.spark_partition_id().cast("long")), "leaves")
    ids = sorted(r["part"] for r in table.select("part").distinct().collect())
    sets = len(ids)
    if ids:  # numbers without gaps
        places = F.create_map(*[F.lit(x) for i, p in enumerate(ids) for x in (p, i)])
        table = table.withColumn("part", places[F.col("part")].cast("long"))
    while sets > 1:
        grouped = table.withColumn("part", F.expr(f"part div {MERGED}")).groupBy("part")
        table, sets = written(grouped.applyInPandas(merge, LEAF), "merged-leaves"), -(-sets // MERGED)
    out = table.toPandas()  # at most ``most`` rows
    centres = np.array([np.asarray(t) / n for t, n in zip(out["total"], out["n"], strict=True)]) if len(out) else np.zeros((0, 1))
    order = np.lexsort(centres.T[::-1])
    return out.iloc[order].assign(centre=list(centres[order])).reset_index(drop=True)


# ------------------------------------------------------------ the tree over the leaves

def merge_tree(centres: np.ndarray, n: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """(a, b, height) of every merge, by height; a cluster goes by its smallest member.

    Chains of nearest neighbours end in pairs that are each other's nearest, which
    these linkages may merge at once."""
    m = len(centres)
    d = np.sqrt(np.maximum(_squares(centres, centres), 0))
    for s in range(0, m, 256):  # exact differences, without cancellation
        diff = centres[s:s + 256, None, :] - centres[None, :, :]
        d[s:s + 256] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    if linkage == "ward":
        d = d * d * (2 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
    np.fill_diagonal(d, np.inf)
    size, alive, chain, out = n.astype(float).copy(), np.ones(m, bool), [], []
    while len(out) < m - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        b = int(d[a].argmin())
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain.pop(), chain.pop()
            a, b = min(a, b), max(a, b)
            h = d[a, b]
            out.append((a, b, float(np.sqrt(h) if linkage == "ward" else h)))
            if linkage == "ward":
                rest = size[a] + size[b] + size
                new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * h) / rest
            elif linkage == "complete":
                new = np.maximum(d[a], d[b])
            else:
                new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            new[~alive] = np.inf
            new[a] = np.inf
            d[a], d[:, a] = new, new
            d[b], d[:, b] = np.inf, np.inf
        else:
            chain.append(b)
    return sorted(out, key=lambda x: x[2])


def cut(merges: list[tuple[int, int, float]], m: int, k: int) -> np.ndarray:
    """Cluster of every leaf when the lowest merges have left k clusters."""
    root = np.arange(m)
    for a, b, _ in merges[:max(m - k, 0)]:
        ra, rb = root[a], root[b]
        root[root == max(ra, rb)] = min(ra, rb)
    return np.unique(root, return_inverse=True)[1]


def _numbered(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, cluster) with clusters numbered by their smallest id, from (id, part)."""
    first = labels.groupBy("part").agg(F.min("id").alias("first")).withColumn("one", F.lit(1))
    numbers = running_sums(first, [], "first", ["one"]).select("part", (F.col("cum_one") - 1).cast("int").alias("cluster"))
    return labels.join(numbers, "part").select(F.col("id").alias(id_col), "cluster")


def agglomerate(points: DataFrame, k: int, linkage: str = "ward", id_col: str = "id", vec: str = "features",
                leaves: int = 2000) -> DataFrame:
    """(id, cluster 0..k-1) of every row; fewer clusters if there are fewer different rows.

    ``leaves`` bounds what a task and the driver hold.  Beyond so many different rows,
    leaves hold several, and complete and average linkage take their centres for them."""
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    p = written(N._prep(points, id_col, vec, "id", "v"), "points")
    if linkage == "single":
        return _single(p, k, id_col)
    found = leaf_table(p, max(leaves, k))
    if found.empty:
        return p.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"))
    centres = np.stack(found["centre"].to_numpy())
    part = cut(merge_tree(centres, found["n"].to_numpy(float), linkage), len(centres), k)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            near, _ = _nearest(np.stack(rows["v"].to_numpy()).astype(float), centres) if len(rows) else (np.zeros(0, int), 0)
            yield pd.DataFrame({"id": rows["id"], "part": part[near]})

    return _numbered(written(p.mapInPandas(assign, "id long, part long"), "leaf-labels"), id_col)


# ------------------------------------------------------------ single linkage

def _components_at(p: DataFrame, eps: float) -> DataFrame:
    """Written (id, comp): points closer than eps in steps; comp is the smallest id."""
    edges = N._core_forest(p, eps, N.BLOCK_ROWS)
    parts = connected_components(edges, "src", "dst").withColumnRenamed("node", "id")
    return written(p.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("comp")), "components")


def _edges_between(p: DataFrame, comps: DataFrame, eps: float) -> DataFrame:
    """Written (a, b, w): the least distance within eps of every two components that have one."""
    q = p.join(comps, "id").select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("comp").alias("qc"))
    r = p.join(comps, "id").select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.col("comp").alias("rc"))

    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(qp) and len(rp):
            qc, rc = qp["qc"].to_numpy(), rp["rc"].to_numpy()
            for s, dist in N._pairs(qp, rp):
                here = qc[s:s + len(dist)]
                row, col = np.nonzero((dist <= eps) & (here[:, None] < rc[None, :]))
                a, b, w = here[row], rc[col], dist[row, col]
                order = np.lexsort((w, b, a))
                a, b, w = a[order], b[order], w[order]
                first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[:len(a)]
                out.append((a[first], b[first], w[first]))
        a, b, w = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"a": a, "b": b, "w": w})

    qx, rx = N._on_grid(q, r, eps)
    met = N._met(qx, rx, N.GRID, N.BLOCK_ROWS, kernel, "a long, b long, w double", ("qid", "qv", "qc"), ("rid", "rv", "rc"))
    return written(met.groupBy("a", "b").agg(F.min("w").alias("w")), "component-edges")


def _kruskal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of all edges of one task, least edges first."""
    parts = list(batches)
    if not parts:
        return
    edges = pd.concat(parts).sort_values(["w", "a", "b"], ignore_index=True)
    nodes, at = np.unique(np.concatenate([edges["ca"], edges["cb"]]), return_inverse=True)
    root = list(range(len(nodes)))
    kept = []
    for i, (a, b) in enumerate(zip(at[:len(edges)].tolist(), at[len(edges):].tolist(), strict=True)):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            kept.append(i)
    yield edges.loc[kept, ["a", "b", "w"]]


def minimum_forest(edges: DataFrame) -> DataFrame:
    """Written (a, b, w): the minimum spanning forest of ``edges`` by Borůvka rounds.

    In a round every component takes its least edge (w, then a, then b), and what these
    join is one component in the next; a round at least halves the components.
    Once ``LAST_EDGES`` or fewer are left, one task finishes."""
    left = edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    taken = []
    while left.count() > LAST_EDGES:
        edge = F.struct("w", "a", "b")
        ends = left.select(F.col("ca").alias("c"), edge.alias("e")).union(left.select(F.col("cb").alias("c"), edge.alias("e")))
        best = ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        chosen = written(best.join(left.drop("w"), ["a", "b"]), "chosen-edges")
        taken.append(chosen.select("a", "b", "w"))
        parts = written(connected_components(chosen, "ca", "cb"), "joined")
        for side in ("ca", "cb"):
            left = left.join(parts.select(F.col("node").alias(side), F.col("component").alias("to")), side, "left").select(
                "a", "b", "w", *[F.coalesce("to", side).alias(c) if c == side else c for c in ("ca", "cb")])
        left = written(left.where("ca <> cb"), "edges-left")
    out = left.coalesce(1).mapInPandas(_kruskal, "a long, b long, w double")
    for t in taken:
        out = out.union(t)
    return written(out, "forest")


def _first_distance(p: DataFrame) -> float:
    """About the distance of neighbours if points were spread evenly over their ranges."""
    row = p.agg(F.count("*").alias("n"), *[x for i in range(3) for x in (
        F.max(F.get("v", F.lit(i))).alias(f"h{i}"), F.min(F.get("v", F.lit(i))).alias(f"l{i}"))]).first()
    ranges = [row[f"h{i}"] - row[f"l{i}"] for i in range(3) if row[f"h{i}"] is not None]
    ranges = [r for r in ranges if r > 0]
    return float(np.prod(ranges) / row["n"]) ** (1 / len(ranges)) if ranges else 0.0


def _single(p: DataFrame, k: int, id_col: str) -> DataFrame:
    if p.select("v").distinct().count() <= k:  # equal rows are together
        return _numbered(_components_at(p, 0.0).withColumnRenamed("comp", "part"), id_col)
    eps = _first_distance(p) or 1.0
    low, high = None, None
    while True:  # ``low`` leaves more than k components, the distance ``high`` at most k
        comps = _components_at(p, eps)
        n = comps.select("comp").distinct().count()
        if n == k:
            return _numbered(comps.withColumnRenamed("comp", "part"), id_col)
        if n > k:
            low, many = comps, n
            if high is not None:
                break
            eps *= 2
        else:
            high = eps
            if low is not None:
                break
            eps /= 2
    forest = minimum_forest(_edges_between(p, low, high))
    joins = many - k
    ranked = running_sums(forest.withColumn("one", F.lit(1)), [], ["w", "a", "b"], ["one"])
    parts = connected_components(ranked.where(F.col("cum_one") <= joins), "a", "b").withColumnRenamed("node", "comp")
    out = low.join(parts, "comp", "left").select("id", F.coalesce("component", "comp").alias("part"))
    return _numbered(written(out, "single-linkage"), id_col)
