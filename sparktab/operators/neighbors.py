"""Exact neighbour operators that skip far pairs.

* Within a distance (counts, DBSCAN, single linkage): points lie in grid cells
  of the leading three coordinates, as wide as the distance; a point meets the
  points of the adjacent cells only.
* DBSCAN and single linkage of points that lie close together, in up to three
  coordinates: cells so small that all points of one are near to each other.
  Only points of cells with few points are counted one by one, and two cells are
  linked by the boxes of their parts, by points only where boxes cannot tell.
* k nearest (k-NN, LOF, 1-NN labels): reference rows lie in the leaves of a tree of
  pivots.  A query's first leaf gives a bound on its kth distance; handed down
  the levels, it leads only to leaves that can hold something closer.  Where these are
  many (in many dimensions), all blocks of reference rows stream past the queries
  instead, and nothing is written or shuffled per query and leaf.

A crowded cell is cut into blocks of a bounded size on both sides, so no task
holds more than two blocks whatever the skew.  Kernels emit only what the caller
needs (top-k, a count, a spanning forest).  Ties go to the smaller reference id."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_int
from ..session import written
from .components import connected_components
from .running import running_sums

BLOCK_ROWS = 4096
# Scratch budget (doubles) of one distance chunk inside a task.
CHUNK_CELLS = 4_000_000
#: Rows of a leaf of the metric tree, and pivots of a node on average.
LEAF_ROWS, FAN = 2048, 32
ROOT = -1
#: Leaves a query may visit on average before blocks stream instead, rows of such a block, and query blocks of a task.
FEW_LEAVES, STREAM_ROWS, TASK_BLOCKS = 4, 4096, 16
GRID = ["c0", "c1", "c2"]
#: Queries of one kernel call, on average, when cells are small.
CALL_ROWS = 512
#: Rows of a cell from which on density methods use small cells.
CROWD = 256


def _prep(df: DataFrame, id_col: str, vec_col: str, idn: str, vn: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(idn), F.col(vec_col).cast("array<double>").alias(vn))


def _met(q: DataFrame, r: DataFrame, keys: Sequence[str], block_rows: int, kernel: Callable, schema: str,
         q_cols: Sequence[str] = ("qid", "qv"), r_cols: Sequence[str] = ("rid", "rv")) -> DataFrame:
    """Run ``kernel(query block, reference block)`` where cells ``keys`` agree.

    A cell with more than ``block_rows`` rows on a side has several blocks there;
    small cells share a call, in which :func:`_pairs` keeps them apart."""
    keys = list(keys)
    nq = q.groupBy(*keys).agg(F.count("*").alias("rows"), F.ceil(F.count("*") / block_rows).alias("nq"))
    nr = r.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).alias("nr"))
    sizes = written(nq.join(nr, keys).withColumn("cell", F.monotonically_increasing_id()), "cells")
    rows = sizes.agg(F.sum("rows")).first()[0] or 0
    call = F.pmod(F.xxhash64("cell"), F.lit(-(-rows // min(CALL_ROWS, block_rows)) or 1)).alias("call")
    one_of = lambda i, n, seed: F.pmod(hash_int(i, seed), F.col(n)).alias
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias
    qx = q.join(sizes, keys).select(F.col("cell").alias("cell"), call, *q_cols, one_of("qid", "nq", 17)("bq"), every("nr")("br"))
    rx = r.join(sizes, keys).select((F.col("cell") + 0).alias("cell"), call, *r_cols, one_of("rid", "nr", 18)("br"), every("nq")("bq"))
    on = ["call", "bq", "br"]
    return qx.groupBy(*on).cogroup(rx.groupBy(*on)).applyInPandas(kernel, schema)


def _pairs(qp: pd.DataFrame, rp: pd.DataFrame):
    """Yield (row slice, distances), infinite between rows of different cells."""
    qc, rc = qp["cell"].to_numpy(), rp["cell"].to_numpy()
    for s, dist in _dist_chunks(_stack(qp["qv"]), _stack(rp["rv"])):
        dist[qc[s:s + len(dist), None] != rc[None, :]] = np.inf
        yield s, dist


def _cell(vec: str, width: float, i: int):
    return F.when(F.size(vec) > i, F.floor(F.get(vec, F.lit(i)) / F.lit(width))).otherwise(F.lit(0).cast("long"))


def _on_grid(q: DataFrame, r: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Queries in their own cell, reference rows in it and in all adjacent ones."""
    width = eps * 1.001 if eps > 0 else 1.0  # a little wider than eps, for rounding
    near = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip(GRID, o, strict=True)])
                     for o in product((-1, 0, 1), repeat=3)])
    live = F.array_distinct(F.transform(near, lambda o: F.struct(*[
        F.when(F.size("rv") > i, o[c]).otherwise(F.lit(0).cast("long")).alias(c) for i, c in enumerate(GRID)])))
    qx = q.select("*", *[_cell("qv", width, i).alias(c) for i, c in enumerate(GRID)])
    rx = r.select("*", F.explode(live).alias("o")).select(
        *r.columns, *[(_cell("rv", width, i) + F.col(f"o.{c}")).alias(c) for i, c in enumerate(GRID)])
    return qx, rx


def _dist_chunks(Q: np.ndarray, R: np.ndarray):
    """Yield (row slice, exact Euclidean distances) by direct differences."""
    step = max(1, CHUNK_CELLS // max(1, R.shape[0] * max(1, R.shape[1])))
    for s in range(0, Q.shape[0], step):
        diff = Q[s:s + step, None, :] - R[None, :, :]
        yield s, np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


def _stack(col: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in col.values], dtype=float) \
        if len(col) else np.zeros((0, 0))


def _top_k(k: int, exclude_self: bool) -> Callable:
    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(qp) and len(rp):
            qids, rids = qp["qid"].to_numpy(), rp["rid"].to_numpy()
            most = min(k, len(rids))
            for s, dist in _pairs(qp, rp):
                if exclude_self:
                    dist[qids[s:s + len(dist), None] == rids[None, :]] = np.inf
                kth = np.partition(dist, most - 1, axis=1)[:, most - 1]
                row, col = np.nonzero((dist <= kth[:, None]) & np.isfinite(dist))
                d = dist[row, col]
                order = np.lexsort((rids[col], d, row))
                row, col, d = row[order], col[order], d[order]
                start = np.searchsorted(row, row, "left")
                top = np.arange(len(row)) - start < k
                out.append((qids[s + row[top]], rids[col[top]], d[top]))
        q, r, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"qid": q, "rid": r, "dist": d})
    return kernel


# --------------------------------------------------------------- metric tree

TREE = "rid long, rv array<double>, node long, far double"


class MetricTree:
    """Reference rows in a tree of pivots, built level by level.

    A node with more than ``leaf_rows`` rows takes about ``FAN`` of them as pivots and
    every row goes to its nearest one; that makes the nodes of the next level.  ``levels``
    holds one written table (node, rid, rv, n, inner, outer) each: the children ``rid`` of
    a node with their pivots, rows, and least and greatest distance of a row to the pivot.
    ``rows`` are (rid, rv, node) with the leaf of every row.  Only counts reach the driver."""

    def __init__(self, rows: DataFrame, leaf_rows: int, block_rows: int):
        self.block_rows, self.leaf_rows, self.levels, done = block_rows, leaf_rows, [], []
        rows = rows.withColumn("node", F.lit(ROOT).cast("long"))
        while True:
            same = F.xxhash64("rv")  # rows that are all equal cannot be split
            sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min(same).alias("lo"), F.max(same).alias("hi"))
            large = written(sizes.where((F.col("n") > leaf_rows) & (F.col("lo") != F.col("hi"))).select("node", "n"), "large-nodes")
            if large.isEmpty():
                break
            done.append(rows.join(large, "node", "left_anti"))
            rows, pivots = self._split(rows.join(large, "node"))
            self.levels.append(pivots)
        self.rows = rows
        for d in done:
            self.rows = self.rows.unionByName(d)
        self.rows = written(self.rows, "leaf-rows")

    def _split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        level = len(self.levels)
        share = F.least(F.lit(float(FAN)) / F.col("n"), F.lit(8.0 / self.leaf_rows))
        chosen = hash_int("rid", 23 + level).cast("double") < share * float(1 << 32)
        picks = rows.where(chosen).select("node", F.col("rv").alias("pv")).distinct()
        # pairs of ids, as a node with one pivot has a child of its own for the rows that equal it
        picks = written(picks.select("node", "pv", ((F.monotonically_increasing_id() + F.lit(level << 56)) * 2).alias("child")),
                        "pivots")
        few = picks.groupBy("node").agg((F.count("*") == 1).alias("alone"))
        picks = picks.join(few, "node").select("node", F.col("child").alias("rid"), F.col("pv").alias("rv"), "alone")
        asked = rows.join(few.select("node"), "node", "left_semi").select(
            "node", F.col("rid").alias("qid"), F.col("rv").alias("qv"))

        def nearest(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
            best, far = np.zeros(len(qp), np.int64), np.full(len(qp), np.inf)
            if len(qp) and len(rp):
                ids, alone = rp["rid"].to_numpy(np.int64), rp["alone"].to_numpy(bool)
                for s, dist in _pairs(qp, rp):
                    at = dist.argmin(1)
                    d = dist[np.arange(len(dist)), at]
                    best[s:s + len(dist)], far[s:s + len(dist)] = ids[at] + (alone[at] & (d > 0)), d
            return pd.DataFrame({"rid": qp["qid"].to_numpy(np.int64), "rv": qp["qv"], "node": best, "far": far})

        # a pivot block holds all pivots of a node: there are about FAN, and blocks are larger
        moved = written(_met(asked, picks, ["node"], max(self.block_rows, 4 * FAN), nearest, TREE,
                             r_cols=("rid", "rv", "alone")), "tree-level")
        cells = moved.groupBy("node").agg(F.count("*").alias("n"), F.min("far").alias("inner"), F.max("far").alias("outer"))
        pivots = picks.select("node", "rv", F.explode(F.array(F.col("rid"), F.col("rid") + 1)).alias("rid"))
        cells = cells.withColumnRenamed("node", "rid")
        # nodes without a pivot, by a rare chance, stay as they are and are tried again a level below
        unsplit = rows.join(few.select("node"), "node", "left_anti").select("rid", "rv", "node")
        kept = moved.select("rid", "rv", "node").unionByName(unsplit)
        return kept, written(pivots.join(cells, "rid"), "tree-pivots")

    def _down(self, queries: DataFrame, choose: Callable, most: float | None = None) -> DataFrame | None:
        """(qid, qv, bound, node) of the leaves that ``choose`` leads every query to, or None
        if a level has more than ``most`` of them for a query on average."""
        schema = "qid long, qv array<double>, bound double, nodes array<long>"
        at = queries.select("qid", "qv", "bound", F.lit(ROOT).cast("long").alias("node"))
        limit = None if most is None else most * queries.count()

        def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
            out = [qp[["qid", "qv", "bound"]].iloc[:0].assign(nodes=pd.Series([], dtype=object))]
            if len(qp) and len(rp):
                bound, child = qp["bound"].to_numpy(float), rp["rid"].to_numpy(np.int64)
                stats = [rp[c].to_numpy(float) for c in ("n", "inner", "outer")]
                for s, dist in _pairs(qp, rp):
                    pick = choose(dist, bound[s:s + len(dist)], *stats)
                    some = np.flatnonzero(pick.any(1))
                    out.append(qp[["qid", "qv", "bound"]].iloc[s + some].assign(nodes=[child[x] for x in pick[some]]))
            return pd.concat(out)

        for pivots in self.levels:
            inner = pivots.select("node").distinct()
            # a query's vector is written once for all children
            down = written(_met(at.join(inner, "node", "left_semi"), pivots, ["node"], max(self.block_rows, 8 * FAN), kernel, schema,
                                ("qid", "qv", "bound"), ("rid", "rv", "n", "inner", "outer")), "tree-queries")
            if limit is not None and (down.agg(F.sum(F.size("nodes"))).first()[0] or 0) > limit:
                return None
            at = down.select("qid", "qv", "bound", F.explode("nodes").alias("node")) \
                .unionByName(at.join(inner, "node", "left_anti"))
        return at

    def homes(self, queries: DataFrame, enough: int) -> DataFrame:
        """The nearest leaf with ``enough`` rows on the way of nearest pivots, or all
        children of the last node if none has so many."""
        def choose(dist, bound, n, inner, outer):
            able = np.where((n >= enough)[None, :], dist, np.inf)
            best = able.min(1)
            pick = np.zeros(dist.shape, bool)
            pick[np.arange(len(dist)), able.argmin(1)] = True
            return np.where(np.isfinite(best)[:, None], pick, np.isfinite(dist))
        return self._down(queries.withColumn("bound", F.lit(float("inf"))), choose)

    def within(self, queries: DataFrame, most: float | None = None) -> DataFrame | None:
        """All leaves that can hold a row within a query's ``bound``: by the triangle
        inequality at the pivot, and by the half-space of the rows nearest to it.
        None if these are more than ``most`` for a query on average."""
        def choose(dist, bound, n, inner, outer):
            b = (bound * (1 + 1e-9) + 1e-9)[:, None]
            near = dist.min(1, keepdims=True)
            with np.errstate(invalid="ignore"):
                return np.isfinite(dist) & (dist - outer <= b) & (inner - dist <= b) & ((dist - near) / 2 <= b)
        return self._down(queries, choose, most)


def knn_visits(q: DataFrame, tree: MetricTree, k: int, exclude_self: bool) -> tuple[DataFrame, Callable]:
    """(first visits of ``q`` (qid, qv), a function from bounds to all further ones, or
    None if they are more than ``most`` for a query on average)."""
    home = tree.homes(q, k + exclude_self)

    def further(bounds: DataFrame, most: float | None = None) -> DataFrame | None:
        asked = q.join(bounds, "qid", "left").fillna(float("inf"), ["bound"])
        visits = tree.within(asked, most)
        return None if visits is None else visits.join(home.select("qid", "node"), ["qid", "node"], "left_anti")
    return home, further


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Blocks of up to ``STREAM_ROWS`` of the rows (id, v, bound), as bytes, in columns that begin with ``name``.

    Rows without an id or with a coordinate that is no finite number are near to nothing."""
    cols = [name + c for c in ("ids", "vecs", "bounds")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in np.array_split(np.arange(len(batch)), -(-len(batch) // STREAM_ROWS) or 1):
                if len(at):
                    ids, vecs, bounds = batch.slice(int(at[0]), len(at)).columns
                    if pa.compute.count_distinct(pa.compute.list_value_length(vecs)).as_py() > 1:
                        raise ValueError("vectors differ in length")
                    data = [x.to_numpy(zero_copy_only=False).tobytes() for x in (ids, vecs.flatten(), bounds)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], cols)

    kept = rows.where(F.col("id").isNotNull() & _finite("v")).select("id", "v", "bound")
    return kept.mapInArrow(run, ", ".join(f"{c} binary" for c in cols))


def _put_nearest(qids: np.ndarray, q: np.ndarray, bound: np.ndarray, dist: np.ndarray, ids: np.ndarray,
                 rids: np.ndarray, r: np.ndarray, exclude_self: bool) -> None:
    """Put the reference rows that are among the nearest of a query into its row of ``dist`` and
    ``ids``, which are in order; ``bound`` is what its last distance cannot exceed.

    Products of matrices only tell what cannot be near; distances are by differences."""
    k, dim = dist.shape[1], q.shape[1]
    centre = r.mean(0)
    span = np.sqrt(((r - centre) ** 2).sum(1).max())
    far = np.sqrt(((q - centre) ** 2).sum(1))
    qq, rr = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", r, r)
    size = np.sqrt(qq) + np.sqrt(rr.max())
    able = np.flatnonzero(~(far - span > bound * (1 + 1e-9) + 1e-9 * (far + span) + 1e-12 * size))
    own = exclude_self and len(np.intersect1d(qids, rids)) > 0
    step = max(1, CHUNK_CELLS // len(r))
    for s in range(0, len(able), step):
        at = able[s:s + step]
        x = q[at]
        near = qq[at, None] + rr[None, :] - 2 * (x @ r.T)  # squares of the distances but for rounding
        slack = 1e-15 * (dim + 16) * size[at] ** 2
        if own:
            near[qids[at, None] == rids[None, :]] = np.inf
        limit = bound[at] ** 2 * (1 + 1e-8) + slack
        many = np.flatnonzero((near <= limit[:, None]).sum(1) > 4 * k)
        if len(many):
            most = min(k, len(r))
            limit[many] = np.minimum(limit[many], np.partition(near[many], most - 1, axis=1)[:, most - 1] + 2 * slack[many])
        row, col = np.nonzero(~(near > limit[:, None]))
        d = np.empty(len(row))
        for c in range(0, len(row), part := max(1, CHUNK_CELLS // max(1, dim))):
            diff = x[row[c:c + part]] - r[col[c:c + part]]
            d[c:c + part] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        last, last_id, found = dist[at, -1][row], ids[at, -1][row], rids[col]
        better = np.isfinite(d) & ((d < last) | ((d == last) & (found < last_id)))
        if own:
            better &= found != qids[at][row]
        row, d, found = row[better], d[better], found[better]
        new = np.unique(row)
        all_row, all_d, all_id = (np.concatenate(t) for t in (
            (np.repeat(new, k), row), (dist[at[new]].ravel(), d), (ids[at[new]].ravel(), found)))
        order = np.lexsort((all_id, all_d, all_row))
        all_row = all_row[order]
        top = order[np.arange(len(order)) - np.searchsorted(all_row, all_row, "left") < k]
        dist[at[new]], ids[at[new]] = all_d[top].reshape(-1, k), all_id[top].reshape(-1, k)
        bound[at[new]] = np.minimum(bound[at[new]], dist[at[new], -1])


def _streamed(asked: DataFrame, rows: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(qid, rid, dist) of the k nearest of ``rows`` (rid, rv, node) for every query (qid, qv, bound).

    A task keeps the nearest of its query blocks while all reference blocks are read past them: time
    grows with the pairs of blocks, but what is shuffled, written and held does not."""
    spark = asked.sparkSession
    parts = lambda df: -(-df.count() // (2 * STREAM_ROWS)) or 1
    r = rows.select(F.col("rid").alias("id"), F.col("rv").alias("v"), F.lit(0.0).alias("bound"), "node")
    r = r.repartitionByRange(parts(rows), "node", "id").sortWithinPartitions("node")
    r = written(_packed(r, "r"), "reference-blocks")
    q = asked.select(F.col("qid").alias("id"), F.col("qv").alias("v"), "bound")
    q = written(_packed(q.repartition(parts(asked)), "q"), "query-blocks").withColumn("block", F.monotonically_increasing_id())
    blocks = q.count()
    tasks = max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism), -(-blocks // TASK_BLOCKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for batch in batches:
            for block, *cells in zip(*(batch.column(c) for c in ("block", "qids", "qvecs", "qbounds", "rids", "rvecs")), strict=True):
                qids, qv, bound, rids, rv = (np.frombuffer(x.as_buffer(), t) for x, t in zip(cells, ("i8", "f8", "f8", "i8", "f8"), strict=True))
                if block.as_py() not in kept:
                    kept[block.as_py()] = (qids.copy(), bound.copy(), np.full((len(qids), k), np.inf),
                                           np.full((len(qids), k), np.iinfo(np.int64).max))
                qids, bound, dist, ids = kept[block.as_py()]
                _put_nearest(qids, qv.reshape(len(qids), -1), bound, dist, ids, rids, rv.reshape(len(rids), -1), exclude_self)
        for qids, _, dist, ids in kept.values():
            row, col = np.nonzero(np.isfinite(dist))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qids[row], ids[row, col], dist[row, col])], ["qid", "rid", "dist"])

    # one reference partition passes by every partition of queries, which Spark holds in the task
    met = r.select("rids", "rvecs").coalesce(1).hint("shuffle_replicate_nl").crossJoin(q.repartition(tasks))
    return met.mapInArrow(run, "qid long, rid long, dist double")


def knn_tree(ref: DataFrame, k: int, rid: str = "id", rvec: str = "features",
             block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> MetricTree:
    """The reference rows of :func:`knn_join` for up to ``k`` neighbours, a row itself counted.
    Rows without an id are nobody's neighbours."""
    named = _prep(ref, rid, rvec, "rid", "rv").where(F.col("rid").isNotNull())
    return MetricTree(written(named, "knn-reference"), max(leaf_rows, 2 * k), block_rows)


def knn_join(query: DataFrame, ref: DataFrame, k: int, qid: str = "id", rid: str = "id",
             qvec: str = "features", rvec: str = "features", exclude_self: bool = False,
             block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS, tree: MetricTree | None = None) -> DataFrame:
    """Exact k nearest reference rows per query row →
    (qid, rid, dist, rank 1..k).  ``exclude_self`` drops rid == qid.

    A query's first leaf gives a bound on its kth distance, and with that it goes down
    the tree once more, to the leaves that can hold something closer; if these are more than
    ``FEW_LEAVES`` on average, it meets all reference rows in blocks instead.  ``tree``: of
    :func:`knn_tree`, if ``ref`` has one already."""
    q = written(_prep(query, qid, qvec, "qid", "qv"), "knn-queries")
    tree = tree or knn_tree(ref, k + exclude_self, rid, rvec, block_rows, leaf_rows)
    home, further = knn_visits(q, tree, k, exclude_self)
    kernel, found = _top_k(k, exclude_self), "qid long, rid long, dist double"
    first = written(_met(home, tree.rows, ["node"], block_rows, kernel, found), "knn-near")
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = ranked(first)
    if tree.levels:
        bounds = best.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(float("inf")).alias("bound"))
        bounds = written(bounds, "knn-bounds")
        visits = further(bounds, FEW_LEAVES)
        if visits is None:
            asked = q.join(bounds, "qid", "left").fillna(float("inf"), ["bound"])
            best = ranked(_streamed(asked, tree.rows, k, exclude_self))
        else:
            more = _met(visits, tree.rows, ["node"], block_rows, kernel, found)
            best = ranked(best.drop("rank").unionByName(more))
        best = written(best, "knn-best")
    return best


def nearest_label(query: DataFrame, ref: DataFrame, label: str, qid: str = "id", rid: str = "id",
                  qvec: str = "features", rvec: str = "features") -> DataFrame:
    """Each query row takes the label of its closest reference row."""
    nn = knn_join(query, ref, 1, qid, rid, qvec, rvec)
    labels = ref.select(F.col(rid).cast("long").alias("rid"), F.col(label).alias(label))
    return nn.join(labels, "rid").select("qid", "rid", "dist", label)


def knn_vote(neigh: DataFrame, ref: DataFrame, label: str, rid: str = "id",
             weights: str = "uniform") -> DataFrame:
    """M11 classify: majority label among the k neighbours (weights
    ``uniform`` or ``distance``); ties → smallest label."""
    lab = ref.select(F.col(rid).cast("long").alias("rid"), F.col(label).alias("_lab"))
    j = neigh.join(lab, "rid")
    w = F.lit(1.0) if weights == "uniform" else F.when(F.col("dist") == 0, F.lit(1e300)).otherwise(1.0 / F.col("dist"))
    g = j.groupBy("qid", "_lab").agg(F.sum(w).alias("votes"))
    best = g.groupBy("qid").agg(F.min_by("_lab", F.struct(-F.col("votes"), F.col("_lab"))).alias("prediction"))
    return best


def knn_mean(neigh: DataFrame, ref: DataFrame, target: str, rid: str = "id",
             weights: str = "uniform") -> DataFrame:
    """M11 regress: (weighted) mean target of the k neighbours."""
    t = ref.select(F.col(rid).cast("long").alias("rid"), F.col(target).cast("double").alias("_y"))
    j = neigh.join(t, "rid")
    if weights == "uniform":
        return j.groupBy("qid").agg(F.avg("_y").alias("prediction"))
    w = F.when(F.col("dist") == 0, F.lit(1e300)).otherwise(1.0 / F.col("dist"))
    return j.groupBy("qid").agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("prediction"))


LOF_AUTO_THRESHOLD = 1.5  # fixed value: 'auto' contamination offset


def local_outlier_factor(train: DataFrame, k: int = 20, id_col: str = "id",
                         vec: str = "features", query: DataFrame | None = None) -> DataFrame:
    """LOF from joins and aggregates.  Training neighbourhoods exclude
    the point itself: k-distance, reachability max(k-dist(o), d(p, o)),
    lrd = 1 / (mean reach-dist + 1e-10).  ``query`` rows (novelty scoring;
    pass the training frame to score it the way a fitted novelty model
    does) take their k nearest training rows, self included:
    LOF = mean lrd(o) / lrd(p); anomaly when LOF > 1.5."""
    tree = knn_tree(train, k + 1, id_col, vec)
    nn = knn_join(train, train, k, id_col, id_col, vec, vec, exclude_self=True, tree=tree)
    kd = nn.groupBy("qid").agg(F.max("dist").alias("kdist"))
    reach = nn.join(kd.select(F.col("qid").alias("rid"), F.col("kdist").alias("kd_o")), "rid") \
        .select("qid", "rid", F.greatest(F.col("dist"), F.col("kd_o")).alias("reach"))
    lrd = reach.groupBy("qid").agg((1.0 / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    if query is None:
        qnn, qlrd = nn, lrd
    else:
        qnn = knn_join(query, train, k, id_col, id_col, vec, vec, tree=tree)
        qreach = qnn.join(kd.select(F.col("qid").alias("rid"), F.col("kdist").alias("kd_o")), "rid") \
            .select("qid", "rid", F.greatest(F.col("dist"), F.col("kd_o")).alias("reach"))
        qlrd = qreach.groupBy("qid").agg((1.0 / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    ol = qnn.join(lrd.select(F.col("qid").alias("rid"), F.col("lrd").alias("lrd_o")), "rid") \
        .groupBy("qid").agg(F.avg("lrd_o").alias("m"))
    return ol.join(qlrd, "qid").select(F.col("qid").alias(id_col), (F.col("m") / F.col("lrd")).alias("lof"))


# ----------------------------------------------------------------- DBSCAN

def _within(eps: float) -> Callable:
    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(qp), np.int64)
        if len(qp) and len(rp):
            for s, dist in _pairs(qp, rp):
                n[s:s + len(dist)] = (dist <= eps).sum(axis=1)
        return pd.DataFrame({"qid": qp["qid"].to_numpy(np.int64), "n": n})
    return kernel


def neighbour_counts(points: DataFrame, eps: float, id_col: str = "id", vec: str = "features",
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """J5 aggregate: number of points within ``eps`` (self included)."""
    q = _prep(points, id_col, vec, "qid", "qv")
    r = _prep(points, id_col, vec, "rid", "rv")

    c = _met(*_on_grid(q, r, eps), GRID, block_rows, _within(eps), "qid long, n long")
    return c.groupBy("qid").agg(F.sum("n").alias("n_neighbors"))


def _forest(q_ids: np.ndarray, r_ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the smallest id reachable inside one block pair."""
    q_label, r_label = q_ids.copy(), r_ids.copy()
    none = np.iinfo(np.int64).max
    while True:
        q_new = np.minimum(q_label, np.where(near, r_label[None, :], none).min(1))
        r_new = np.minimum(r_label, np.where(near, q_new[:, None], none).min(0))
        if (q_new == q_label).all() and (r_new == r_label).all():
            break
        q_label, r_label = q_new, r_new
    src, dst = np.concatenate([q_ids, r_ids]), np.concatenate([q_label, r_label])
    return src[src != dst], dst[src != dst]


def _core_forest(core: DataFrame, eps: float, block_rows: int) -> DataFrame:
    q = core.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    r = core.select(F.col("id").alias("rid"), F.col("v").alias("rv"))

    def kernel(qp, rp):
        src = dst = np.zeros(0, np.int64)
        if len(qp) and len(rp):
            near = np.concatenate([d <= eps for _, d in _pairs(qp, rp)])
            src, dst = _forest(qp["qid"].to_numpy(np.int64), rp["rid"].to_numpy(np.int64), near)
        return pd.DataFrame({"src": src, "dst": dst})

    return _met(*_on_grid(q, r, eps), GRID, block_rows, kernel, "src long, dst long").distinct()


class _SmallCells:
    """Points of ``dim`` coordinates in cells ``g`` whose points are all within ``eps`` of each other."""

    REACH = 2  # eps is at most sqrt(3) cells and a little, so it ends two cells on

    def __init__(self, eps: float, dim: int, block_rows: int):
        self.eps, self.dim, self.block_rows = eps, dim, block_rows
        self.width = eps / dim ** 0.5 * (1 - 1e-6)  # a little smaller, for rounding
        self.parts = 16 if dim < 3 else 8

    @classmethod
    def of(cls, points: DataFrame, eps: float, crowd: int, block_rows: int) -> _SmallCells | None:
        """Small cells if some cell of the wide grid has more than ``crowd`` rows and they can be told exactly."""
        if not eps > 0:
            return None
        cells = [_cell("v", eps, i).alias(c) for i, c in enumerate(GRID)]
        far = F.array_max(F.transform("v", F.abs))
        s = points.where(_finite("v")).groupBy(*cells).agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"),
                                                           F.max(F.size("v")).alias("hi"), F.max(far).alias("far"))
        s = s.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("far").alias("far")).first()
        if s["n"] is None or s["n"] <= crowd or s["lo"] != s["hi"] or not 0 < s["hi"] <= len(GRID) or s["far"] / eps > 1e8:
            return None
        return cls(eps, s["hi"], block_rows)

    def _place(self, vec: str, width: float):
        return F.array(*[F.floor(F.get(vec, F.lit(i)) / F.lit(width)) for i in range(self.dim)])

    def placed(self, points: DataFrame, vec: str) -> DataFrame:
        return points.where(_finite(vec)).withColumn("g", self._place(vec, self.width))

    def _near(self, cells: DataFrame, others: DataFrame) -> DataFrame:
        """``cells`` (g, ...) with the cells ``o`` of ``others`` (o, ...) that can hold a point within eps."""
        steps = product(range(-self.REACH, self.REACH + 1), repeat=self.dim)
        near = F.array(*[F.array(*[F.get("g", F.lit(i)) + F.lit(x).cast("long") for i, x in enumerate(o)]) for o in steps])
        return cells.withColumn("o", F.explode(near)).join(others, "o")

    def meet(self, q: DataFrame, r: DataFrame, kernel: Callable, schema: str, r_cols: Sequence[str]) -> DataFrame:
        """``kernel`` over the queries of a cell and the reference rows of the cells around it."""
        pairs = self._near(q.select("g").distinct(), r.select(F.col("g").alias("o")).distinct())
        around = r.withColumnRenamed("g", "o").join(pairs, "o").drop("o")
        return _met(q, around, ["g"], self.block_rows, kernel, schema, r_cols=r_cols)

    def counts(self, points: DataFrame, least: int, kernel: Callable) -> DataFrame:
        """(id, n_neighbors): exact up to ``least``, beyond that at least ``least``."""
        rows = written(self.placed(points.where(F.col("id").isNotNull()), "v"), "placed-points")
        few = rows.groupBy("g").count().where(F.col("count") < least).select("g")
        sparse = written(rows.join(few, "g", "left_semi"), "sparse-points")
        met = self.meet(sparse.select("g", F.col("id").alias("qid"), F.col("v").alias("qv")),
                        rows.select("g", F.col("id").alias("rid"), F.col("v").alias("rv")), kernel, "qid long, n long", ("rid", "rv"))
        full = rows.join(few, "g", "left_anti").select("id", F.lit(least).cast("long").alias("n"))
        # a point with a coordinate that is no finite number is near to nothing
        none = points.where(F.forall("v", lambda t: t.isNotNull()) & ~_finite("v")).select("id", F.lit(0).cast("long").alias("n"))
        every = full.unionByName(met.select(F.col("qid").alias("id"), "n")).unionByName(none)
        return every.groupBy("id").agg(F.sum("n").alias("n_neighbors"))

    def components(self, core: DataFrame) -> DataFrame:
        """(id, component) of core points: a cell is one node, named by its smallest id."""
        rows = written(self.placed(core.where(F.col("id").isNotNull()), "v")
                       .withColumn("s", self._place("v", self.width / self.parts)), "placed-core")
        edge = lambda f: F.array(*[f(F.get("v", F.lit(i))) for i in range(self.dim)])
        nodes = rows.groupBy("g", "s").agg(F.min("id").alias("least"), edge(F.min).alias("lo"), edge(F.max).alias("hi"))
        nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "core-parts")
        cells = written(nodes.groupBy("g").agg(F.min("least").alias("rep")), "core-cells")
        pairs = self._near(cells.withColumnRenamed("rep", "src"), cells.select(F.col("g").alias("o"), F.col("rep").alias("dst")))
        pairs = written(pairs.where("src < dst"), "cell-pairs")
        told = written(self._by_boxes(nodes, pairs), "told-pairs")
        links = told.where("a is null").select("src", "dst")
        open_pairs = told.where("a is not null").join(links, ["src", "dst"], "left_anti")
        links = links.union(self._by_points(rows.join(nodes.select("g", "s", "node"), ["g", "s"]), written(open_pairs, "open-pairs")))
        named = rows.join(cells, "g").select("id", "rep").distinct()
        torn = named.groupBy("id").agg(F.min("rep").alias("src"), F.max("rep").alias("most")).where("src < most")  # repeated ids
        links = links.union(named.join(torn, "id").where("src < rep").select("src", F.col("rep").alias("dst")))
        parts = connected_components(links.distinct(), "src", "dst").withColumnRenamed("node", "rep")
        return named.join(parts, "rep", "left").select("id", F.coalesce("component", "rep").alias("component")).distinct()

    def _by_boxes(self, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        """(src, dst, a, b): linked cells, with null parts, and the parts whose boxes cannot tell."""
        sure, maybe = self.eps * (1 - 1e-9), self.eps * (1 + 1e-9)
        schema = "src long, dst long, a long, b long"

        def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"src": [], "dst": [], "a": [], "b": []}, dtype="Int64")]
            if len(qp) and len(rp):
                ql, qh, rl, rh = (_stack(x) for x in (qp["lo"], qp["hi"], rp["rlo"], rp["rhi"]))
                qc, rc = qp["cell"].to_numpy(), rp["cell"].to_numpy()
                a, b, src, dst = (x.to_numpy(np.int64) for x in (qp["qid"], rp["rid"], rp["src"], rp["dst"]))
                step, undecided, linked = max(1, CHUNK_CELLS // (len(rp) * self.dim)), [], np.zeros(len(rp), bool)
                for at in range(0, len(qp), step):
                    lo, hi = ql[at:at + step, None, :], qh[at:at + step, None, :]
                    same = qc[at:at + step, None] == rc[None, :]
                    most = np.maximum(hi - rl[None], rh[None] - lo)
                    least = np.maximum(np.maximum(lo - rh[None], rl[None] - hi), 0)
                    linked |= (same & ((most * most).sum(2) <= sure * sure)).any(0)
                    i, j = np.nonzero(same & ((least * least).sum(2) <= maybe * maybe) & ~linked[None, :])
                    undecided.append((i + at, j))
                cell = pd.MultiIndex.from_arrays([src, dst])
                done = pd.DataFrame({"src": src[linked], "dst": dst[linked]}).drop_duplicates().astype("Int64")
                out.append(done.assign(a=pd.array([None] * len(done), "Int64"), b=pd.array([None] * len(done), "Int64")))
                again = cell.isin(cell[linked]) if linked.any() else linked
                for i, j in undecided:
                    i, j = i[~again[j]], j[~again[j]]
                    out.append(pd.DataFrame({"src": src[j], "dst": dst[j], "a": a[i], "b": b[j]}).astype("Int64"))
            return pd.concat(out)

        q = nodes.join(pairs.select("g").distinct(), "g", "left_semi").select("g", F.col("node").alias("qid"), "lo", "hi")
        r = pairs.join(nodes.select(F.col("g").alias("o"), F.col("node").alias("rid"), F.col("lo").alias("rlo"),
                                    F.col("hi").alias("rhi")), "o")
        return _met(q, r, ["g"], self.block_rows, kernel, schema, ("qid", "lo", "hi"), ("rid", "rlo", "rhi", "src", "dst"))

    def _by_points(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """(src, dst) of the pairs of parts that hold points within eps."""
        points = rows.groupBy("node", "v").agg(F.min("id").alias("id"))  # equal points are one
        q = points.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi") \
            .select("node", F.col("id").alias("qid"), F.col("v").alias("qv"))
        r = points.select(F.col("node").alias("b"), F.col("id").alias("rid"), F.col("v").alias("rv")).join(pairs, "b") \
            .select(F.col("a").alias("node"), "rid", "rv", "src", "dst")

        def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
            hit = np.zeros(len(rp), bool)
            if len(qp) and len(rp):
                for _, dist in _pairs(qp, rp):
                    hit |= (dist <= self.eps).any(0)
            return rp.loc[hit, ["src", "dst"]].drop_duplicates()

        return _met(q, r, ["node"], self.block_rows, kernel, "src long, dst long", r_cols=("rid", "rv", "src", "dst"))


def _finite(vec: str):
    return F.forall(vec, lambda t: t.isNotNull() & ~F.isnan(t - t))


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 5, id_col: str = "id",
           vec: str = "features", block_rows: int = BLOCK_ROWS, crowd: int = CROWD) -> DataFrame:
    """core = at least ``min_samples`` points within eps (self
    counted); clusters = connected components of core points; border points
    join the smallest-numbered cluster among their core neighbours; others
    are noise (−1).  Clusters are numbered 0.. by their smallest core id,
    which is the order a sequential scan in id order discovers them.

    Where more than ``crowd`` points share a cell, the work grows with the points
    and the pairs of cells, not with the pairs of points; the result is the same."""
    p = written(_prep(points, id_col, vec, "id", "v"), "points")
    small = _SmallCells.of(p, eps, crowd, block_rows)
    if alone := min_samples <= 1:  # a point counts itself, unless a coordinate is missing
        placed = p.where(F.forall(F.slice("v", 1, len(GRID)), lambda t: t.isNotNull()))
        p2 = placed.withColumn("core", F.forall("v", lambda t: t.isNotNull() & ~F.isnan(t - t)))
    else:
        if small:
            counts = small.counts(p, min_samples, _within(eps))
        else:
            counts = neighbour_counts(p, eps, "id", "v", block_rows).withColumnRenamed("qid", "id")
        p2 = written(p.join(counts, "id").withColumn("core", F.col("n_neighbors") >= min_samples), "core-points")
    core = p2.where("core").select("id", "v")
    parts = small.components(core) if small else \
        connected_components(_core_forest(core, eps, block_rows), "src", "dst").withColumnRenamed("node", "id")
    comp = core.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    comp = written(comp, "core-components")
    roots = comp.select("comp").distinct().withColumn("_one", F.lit(1))
    numbering = running_sums(roots, [], "comp", ["_one"]).select(
        "comp", (F.col("cum__one") - 1).cast("int").alias("cluster"))
    core_lab = written(comp.join(numbering, "comp").select("id", "cluster"), "core-labels")

    if alone:  # what is no core point is near to nothing
        return _labelled(p2, core_lab, id_col)
    border = p2.where(~F.col("core")).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    cref = core.join(core_lab, "id").select(F.col("id").alias("rid"), F.col("v").alias("rv"), "cluster")

    def kernel(qp, rp):
        none = np.iinfo(np.int32).max
        best = np.full(len(qp), none, np.int64)
        if len(qp) and len(rp):
            cluster = rp["cluster"].to_numpy()
            for s, dist in _pairs(qp, rp):
                best[s:s + len(dist)] = np.where(dist <= eps, cluster[None, :], none).min(axis=1)
        return pd.DataFrame({"qid": qp["qid"].to_numpy(np.int64)[best < none], "cluster": best[best < none].astype("int32")})

    found, r_cols = "qid long, cluster int", ("rid", "rv", "cluster")
    if small:
        joined = small.meet(small.placed(border, "qv"), small.placed(cref, "rv"), kernel, found, r_cols)
    else:
        joined = _met(*_on_grid(border, cref, eps), GRID, block_rows, kernel, found, r_cols=r_cols)
    labels = core_lab.unionByName(joined.groupBy(F.col("qid").alias("id")).agg(F.min("cluster").alias("cluster")))
    return _labelled(p2, labels, id_col)


def _labelled(points: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    return (points.select("id", "core").join(labels, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"), "core"))


def single_linkage(points: DataFrame, distance: float, id_col: str = "id", vec: str = "features",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """M20 (single linkage cut at ``distance``): clusters are the connected
    components of the graph joining points closer than the cut — DBSCAN with
    one point per core, so every point is a core point and nothing is noise.
    Clusters are numbered by their smallest id."""
    return dbscan(points, distance, 1, id_col, vec, block_rows).select(id_col, "cluster")
