"""Exact attribution for tree models (M40): Shapley values along every path.

The value of a set S of known features is the tree's expectation when a split on
an unknown feature sends a row both ways, in the shares of the background rows that
went there (``cover``; equal halves where no row came).  A leaf whose path asks D
different features is a product game: feature i contributes o_i (1 if the row meets all its
conditions on the path) when known and z_i (product of its shares) when not, so its
Shapley weight is

    (o_j - z_j) * integral over y in [0, 1] of  prod_{i != j} (o_i y + z_i (1 - y)),

a polynomial of degree D - 1, which ceil(D / 2) Gauss points integrate exactly.
Rows that no cut of any tree tells apart have the same values, so a task walks the trees once for
every such cell it meets, not for every row; what grows with the rows stays in tasks, and only the trees reach the driver."""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .boosting import BoostedTrees

#: Rows walked through the trees at once.
SLICE = 4096
#: Numbers that a task keeps for the cells it has met, at most 32 MB.
KEPT = 1 << 22


@dataclass
class PathTree:
    """Nodes in arrays; feature -1 is a leaf.  ``value`` has one column per output."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    kinds: dict[int, list] = field(default_factory=dict)  # node -> categories that go left

    def goes_left(self, node: int, v: np.ndarray) -> np.ndarray:
        if node in self.kinds:
            return np.isin(v, self.kinds[node])
        return np.where(np.isnan(v), self.missing_left[node], v <= self.cut[node])

    def shares(self, node: int) -> tuple[float, float]:
        a, b = self.cover[self.left[node]], self.cover[self.right[node]]
        return (a / (a + b), b / (a + b)) if a + b > 0 else (0.5, 0.5)

    def expectation(self, node: int = 0) -> np.ndarray:
        if self.feature[node] < 0:
            return self.value[node]
        a, b = self.shares(node)
        return a * self.expectation(self.left[node]) + b * self.expectation(self.right[node])

    def counts(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x`` that reach each node."""
        out = np.zeros(len(self.feature), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            out[node] = len(rows)
            if self.feature[node] >= 0 and len(rows):
                to = self.goes_left(node, x[rows, self.feature[node]])
                todo += [(self.left[node], rows[to]), (self.right[node], rows[~to])]
        return out

    def add_attributions(self, x: np.ndarray, out: np.ndarray, node: int = 0, met: dict | None = None,
                         share: dict | None = None) -> None:
        """Adds to ``out`` (rows, features, outputs) what every leaf under ``node`` gives."""
        met, share = met or {}, share or {}
        f = int(self.feature[node])
        if f >= 0:
            to = self.goes_left(node, x[:, f])
            for kid, here, part in zip((self.left[node], self.right[node]), (to, ~to), self.shares(node)):
                self.add_attributions(x, out, kid, {**met, f: met[f] & here if f in met else here},
                                      {**share, f: share.get(f, 1.0) * part})
            return
        if not met:
            return
        y, w = np.polynomial.legendre.leggauss((len(met) + 1) // 2)
        y, w = (y + 1) / 2, w / 2
        o = np.stack(list(met.values()), 1).astype(float)
        z = np.array(list(share.values()))
        terms = o[:, :, None] * y + z[None, :, None] * (1 - y)
        before, after = np.ones_like(terms), np.ones_like(terms)
        before[:, 1:] = np.cumprod(terms, 1)[:, :-1]
        after[:, :-1] = np.cumprod(terms[:, ::-1], 1)[:, ::-1][:, 1:]
        weight = (before * after) @ w * (o - z)
        for j, g in enumerate(met):
            out[:, g, :] += weight[:, j, None] * self.value[node]


@dataclass
class PathEnsemble:
    """Trees whose values add up to the model's output, plus what no tree explains."""
    trees: list[PathTree]
    base: np.ndarray
    n_features: int

    def expectation(self) -> np.ndarray:
        return self.base + sum((t.expectation() for t in self.trees), np.zeros(len(self.base)))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features, outputs); over the features they sum to output minus expectation."""
        out = np.zeros((len(x), self.n_features, len(self.base)))
        for s in range(0, len(x), SLICE):
            for t in self.trees:
                t.add_attributions(x[s:s + SLICE], out[s:s + SLICE])
        return out

    def by_cell(self) -> Callable[[np.ndarray], np.ndarray]:
        """``attributions`` for batch after batch that walks the trees once for rows between the same cuts.

        Few possible cells are kept from batch to batch, of many each batch's own are walked; categories
        are not told by cuts, so their trees are walked for every row."""
        d, k = self.n_features, len(self.base)
        cuts = [np.unique(np.concatenate([t.cut[t.feature == f] for t in self.trees] or [np.zeros(0)])) for f in range(d)]
        sizes = [len(c) + 2 for c in cuts]  # missing values are between cuts of their own
        cells = math.prod(sizes)
        if any(t.kinds for t in self.trees) or cells >= 1 << 62:
            return self.attributions
        keep = cells * d * k <= KEPT
        known, seen = (np.zeros((cells, d, k)), np.zeros(cells, bool)) if keep else (None, None)

        def run(x: np.ndarray) -> np.ndarray:
            cell = np.zeros(len(x), np.int64)
            for f, c in enumerate(cuts):
                cell = cell * sizes[f] + np.where(np.isnan(x[:, f]), len(c) + 1, np.searchsorted(c, x[:, f], "left"))
            if not keep:
                _, first, at = np.unique(cell, return_index=True, return_inverse=True)
                return self.attributions(x[first])[at]
            new = np.flatnonzero(~seen[cell])
            if len(new):
                found, first = np.unique(cell[new], return_index=True)
                known[found], seen[found] = self.attributions(x[new[first]]), True
            return known[cell]
        return run

    def with_background(self, rows: DataFrame) -> PathEnsemble:
        """The same trees with covers counted over all ``rows`` (x array<double>)."""
        trees, d = self.trees, self.n_features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = [np.zeros(len(t.feature), np.int64) for t in trees]
            for b in batches:
                x = matrix(b["x"], d)
                for t, n in zip(trees, total):
                    n += t.counts(x)
            for i, n in enumerate(total):
                at = np.flatnonzero(n)
                yield pd.DataFrame({"tree": i, "node": at, "n": n[at]})

        parts = rows.select("x").mapInPandas(run, "tree int, node int, n long")
        covers = [np.zeros(len(t.feature)) for t in trees]
        for tree, node, n in parts.groupBy("tree", "node").agg(F.sum("n")).collect():  # at most one row per node of the model
            covers[tree][node] = n
        return PathEnsemble([PathTree(**{**t.__dict__, "cover": c}) for t, c in zip(trees, covers)], self.base, d)


def matrix(x: pd.Series, d: int) -> np.ndarray:
    """Arrays of a batch as a matrix; nulls become NaN."""
    return np.array([np.full(d, np.nan) if r is None else r for r in x], dtype=float).reshape(len(x), d)


def boosted_paths(model: BoostedTrees, background: DataFrame) -> PathEnsemble:
    """The margins of boosted trees; covers are counted over ``background`` (x array<double>)."""
    width, trees = len(model.base), []
    for group in model.trees:
        for k, t in enumerate(group):
            value = np.zeros((len(t.feature), width))
            value[:, k] = t.weight
            trees.append(PathTree(np.array(t.feature), np.array(t.cut, float), np.array(t.left), np.array(t.right),
                                  np.array(t.missing_left), value, np.zeros(len(t.feature))))
    return PathEnsemble(trees, np.asarray(model.base, float), model.n_features).with_background(background)


def mllib_paths(model, n_features: int) -> PathEnsemble:
    """A fitted MLlib tree, forest or boosted model, read from the node table it saves.

    Outputs: the value (regression), the probabilities of all classes (tree and forest
    classifiers), the raw margin (boosted classifier).  Covers are the training rows of every node."""
    spark = SparkSession.active()
    path = scratch_path(spark, f"tree-nodes-{uuid.uuid4().hex}")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        nodes = nodes.withColumn("tree", F.lit(0))
    rows: dict[int, list] = {}
    for r in nodes.collect():  # the model itself
        rows.setdefault(r["tree"], []).append(r)
    kind = type(model).__name__
    shares = "Classification" in kind and not kind.startswith("GBT")
    if kind.startswith("GBT"):
        weights = list(model.treeWeights)
    else:
        weights = [1.0 / len(rows)] * len(rows)
    width = model.numClasses if shares else 1
    trees = []
    for i in sorted(rows):
        at = sorted(rows[i], key=lambda r: r["id"])
        place = {r["id"]: k for k, r in enumerate(at)}
        leaf = [r["leftChild"] < 0 for r in at]
        value = np.zeros((len(at), width))
        for k, r in enumerate(at):
            stats = np.asarray(r["impurityStats"], float)
            value[k] = stats / stats.sum() if shares and stats.sum() > 0 else (1.0 / width if shares else r["prediction"])
        nominal = {k: list(r["split"]["leftCategoriesOrThreshold"]) for k, r in enumerate(at)
                   if not leaf[k] and r["split"]["numCategories"] >= 0}
        trees.append(PathTree(
            np.array([-1 if gone else r["split"]["featureIndex"] for r, gone in zip(at, leaf)]),
            np.array([0.0 if gone or k in nominal else r["split"]["leftCategoriesOrThreshold"][0]
                      for k, (r, gone) in enumerate(zip(at, leaf))]),
            np.array([place.get(r["leftChild"], -1) for r in at]), np.array([place.get(r["rightChild"], -1) for r in at]),
            np.zeros(len(at), bool), value * weights[i], np.array([r["rawCount"] for r in at], float), nominal))
    return PathEnsemble(trees, np.zeros(width), n_features)


def tree_attributions(df: DataFrame, paths: PathEnsemble, features: Sequence[str] | str, id_col: str) -> DataFrame:
    """(id, output, feature, attribution): the exact Shapley value of every feature in every row.

    ``features`` names numeric columns (nulls count as missing) or one vector column, whose features
    are then numbered.  Repeated ids keep a row set each; an empty table gives no rows."""
    d, k = paths.n_features, len(paths.base)
    if isinstance(features, str):
        x, names = vector_to_array(features), [str(i) for i in range(d)]
    else:
        x, names = F.array(*[F.col(c).cast("double") for c in features]), list(features)
    if len(names) != d:
        raise ValueError(f"the model has {d} features, not {len(names)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attributions = paths.by_cell()
        for b in batches:
            at, n = b.column("x"), b.num_rows
            rows = at.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, d) if not at.null_count and len(
                at.flatten()) == n * d else matrix(at.to_pandas(), d)
            ends = pa.array(np.arange(n + 1) * (d * k), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(
                ends, pa.array(attributions(rows).ravel(), pa.float64()))], ["id", "phi"])

    rows = df.select(F.col(id_col).alias("id"), x.alias("x"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, phi array<double>"
    out = rows.mapInArrow(run, schema).select("id", F.posexplode("phi").alias("at", "attribution"))
    return out.select(F.col("id").alias(id_col), (F.col("at") % k).cast("int").alias("output"),
                      F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("at") / k).cast("int") + 1).alias("feature"),
                      "attribution")


def attribution_ranking(attributions: DataFrame, top: int = 15) -> DataFrame:
    """O5 on tree attributions: features by mean |attribution| over all rows and outputs."""
    mean = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    return mean.orderBy(F.desc("mean_abs"), "feature").limit(top)
