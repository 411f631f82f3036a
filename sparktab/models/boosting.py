"""Second-order boosted trees (M2) on binned features.

Features are binned once (all values as cuts where there are few, else quantiles) and written
as one byte each.  A level of a tree is one job: every task sums gradients
and Hessians per (node, feature, bin), Spark adds the sums up, each (node, feature)
picks its best split in parallel, and one row per node and feature comes back.

With G, H the sums, a = reg_alpha, l = reg_lambda and T(G) = sign(G) max(|G| - a, 0), a leaf weighs
-T(G) / (H + l) times the learning rate, and a split gains T(GL)^2 / (HL + l) + T(GR)^2 / (HR + l) - T(G)^2 / (H + l).
Both sides need a Hessian sum of min_child_weight, and splits above leaves that gain
less than gamma are taken back.  Missing values go to the side that gains more."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

MISSING = 255
#: At most so many cuts a feature, so that a bin and ``MISSING`` fit a byte.
MOST_CUTS = 254
#: Trees after which the rows' margins are written anew.
SETTLED = 5
#: Histograms of (node, feature) that a task sums up at once, some 25 MB.
HISTOGRAMS = 4096
LEAST_GAIN = 1e-6
OBJECTIVES = ("squared", "logistic", "softmax")


@dataclass
class Params:
    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in arrays; feature -1 is a leaf.  Left takes x <= cut, and missing values if ``missing_left``."""
    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    bin: list = field(default_factory=lambda: [0])
    missing_left: list = field(default_factory=lambda: [True])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    weight: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float, at: int, missing_left: bool, gain: float) -> tuple[int, int]:
        kids = len(self.feature), len(self.feature) + 1
        for c, x in (("feature", -1), ("cut", 0.0), ("bin", 0), ("missing_left", True), ("left", -1), ("right", -1),
                     ("weight", 0.0), ("gain", 0.0)):
            getattr(self, c).extend([x, x])
        self.feature[node], self.cut[node], self.bin[node], self.gain[node] = feature, cut, at, gain
        self.missing_left[node], (self.left[node], self.right[node]) = missing_left, kids
        return kids

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The node of every row of binned features as deep as the tree is grown."""
        return self._walk(bins, np.asarray(self.bin), MISSING)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, np.asarray(self.cut, float), None)

    def _walk(self, x: np.ndarray, cut: np.ndarray, missing) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, left, right, ml = (np.asarray(v) for v in (self.feature, self.left, self.right, self.missing_left))
        leaf, own = feature < 0, np.arange(len(feature))
        feature, left, right = np.where(leaf, 0, feature), np.where(leaf, own, left), np.where(leaf, own, right)
        flat, row = x.ravel(), np.arange(len(x)) * x.shape[1]
        while not leaf[at].all():  # rows in a leaf stay there
            v = flat[row + feature[at]]
            gone = v == missing if missing is not None else np.isnan(v)
            at = np.where(np.where(gone, ml[at], v <= cut[at]), left[at], right[at])
        return at

    def prune(self, gamma: float, node: int = 0) -> bool:
        """Take back splits above leaves that gain less than gamma; true if the node is a leaf then."""
        if self.feature[node] < 0:
            return True
        both = [self.prune(gamma, self.left[node]), self.prune(gamma, self.right[node])]
        if all(both) and self.gain[node] < gamma:
            self.feature[node] = -1
        return self.feature[node] < 0


def shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_split(g: np.ndarray, h: np.ndarray, missing: tuple[float, float], p: Params) -> tuple:
    """(gain, bin, missing left, G left, H left) of the best split of one feature's bins; gain 0 if there is none."""
    def score(a, b):
        return shrunk(a, p.reg_alpha) ** 2 / (b + p.reg_lambda + 1e-300)
    total, hess = g.sum() + missing[0], h.sum() + missing[1]
    best = (0.0, 0, True, 0.0, 0.0)
    gl0, hl0 = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    for left in (True, False) if missing[1] > 0 else (True,):
        gl, hl = (gl0 + missing[0], hl0 + missing[1]) if left else (gl0, hl0)
        gr, hr = total - gl, hess - hl
        gain = score(gl, hl) + score(gr, hr) - score(total, hess)
        gain = np.where((hl >= p.min_child_weight) & (hr >= p.min_child_weight), gain, -np.inf)
        if len(gain) and gain.max() > max(best[0], LEAST_GAIN):
            i = int(gain.argmax())
            best = (float(gain[i]), i, left, float(gl[i]), float(hl[i]))
    return best


def feature_cuts(rows: DataFrame, d: int, most: int = MOST_CUTS) -> list[np.ndarray]:
    """Cuts of every feature of ``x``: all values but the last, or at most ``most`` quantiles."""
    long = rows.select(F.posexplode("x").alias("f", "v")).where("v is not null and not isnan(v)")
    values = written(long.groupBy("f", "v").agg(F.count("*").alias("n")), "feature-values")
    few = values.groupBy("f").agg(F.count("*").alias("kinds")).where(F.col("kinds") <= most + 1).select("f")
    cuts = [np.zeros(0) for _ in range(d)]
    for f, v in values.join(few, "f").select("f", "v").toLocalIterator():  # at most d x most values
        cuts[f] = np.append(cuts[f], v)
    cuts = [np.sort(c)[:-1] for c in cuts]
    shares = [float(x) for x in np.arange(1, most + 1) / (most + 1)]
    many = values.join(few, "f", "left_anti").groupBy("f").agg(
        F.sum("n").alias("rows"))
    many = long.join(many.select("f"), "f").groupBy("f").agg(F.percentile_approx("v", shares, 20_000).alias("q"))
    for f, q in many.collect():
        cuts[f] = np.unique(q)
    return cuts


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(row: np.ndarray, round_: int, share: float, seed: int) -> np.ndarray:
    """Which rows a round uses; a row's draw depends on its number alone."""
    if share >= 1:
        return np.ones(len(row), bool)
    with np.errstate(over="ignore"):
        draw = _splitmix(_splitmix(row.astype(np.uint64)) + np.uint64(round_ * 1_000_003 + seed))
    return draw / 2.0 ** 64 < share


def gradients(objective: str, y: np.ndarray, margin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margin of class k."""
    if objective == "squared":
        return margin[:, 0] - y, np.ones(len(y))
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin[:, 0]))
        return p - y, np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(1, keepdims=True))
    p = e[:, k] / e.sum(1)
    return p - (y == k), np.maximum(2 * p * (1 - p), 1e-16)


def _unpacked(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins, margins) of a batch as matrices, without an object a row."""
    n, packed = batch.num_rows, batch.column("bins").cast(pa.large_binary())
    start = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset]
    bins = np.frombuffer(packed.buffers()[2], np.uint8)[start:start + n * d].reshape(n, d)
    return bins, batch.column("margin").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)


def _packed(batch: pa.RecordBatch, bins: pa.Array, margin: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(margin) + 1) * margin.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("y"), bins, pa.ListArray.from_arrays(
        ends, pa.array(margin.ravel(), pa.float64()))], ["row", "y", "bins", "margin"])


class BoostedTrees:
    """Fitted trees: ``trees[round][class]``."""

    def __init__(self, objective: str, base: list[float], trees: list[list[Tree]], n_features: int):
        self.objective, self.base, self.trees, self.n_features = objective, base, trees, n_features

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.asarray(self.base, float), (len(x), 1))
        for group in self.trees:
            for k, t in enumerate(group):
                out[:, k] += np.asarray(t.weight)[t.leaves_of(x)]
        return out

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """The value (squared), or the probabilities of all classes."""
        m = self.margins(x)
        if self.objective == "squared":
            return m
        if self.objective == "logistic":
            p = 1 / (1 + np.exp(-m[:, 0]))
            return np.stack([1 - p, p], 1)
        e = np.exp(m - m.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def importances(self) -> np.ndarray:
        """Mean gain of a feature's splits, summing to one."""
        gain, n = np.zeros(self.n_features), np.zeros(self.n_features)
        for t in (t for g in self.trees for t in g):
            live = [0]
            while live:
                i = live.pop()
                if t.feature[i] >= 0:
                    gain[t.feature[i]] += t.gain[i]
                    n[t.feature[i]] += 1
                    live += [t.left[i], t.right[i]]
        mean = gain / np.maximum(n, 1)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def to_dict(self) -> dict:
        return {"objective": self.objective, "base": self.base, "n_features": self.n_features,
                "trees": [[t.__dict__ for t in g] for g in self.trees]}

    @classmethod
    def from_dict(cls, d: dict) -> BoostedTrees:
        return cls(d["objective"], d["base"], [[Tree(**t) for t in g] for g in d["trees"]], d["n_features"])


def fit(rows: DataFrame, objective: str, n_features: int, params: Params | None = None, classes: int = 2) -> BoostedTrees:
    """Fit on (x array<double>, y double); classes of the classifying objectives are 0, 1, ..."""
    p, d = params or Params(), n_features
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective!r}")
    source = written(rows.select("x", "y", F.monotonically_increasing_id().alias("row")), "boosting-rows")
    cuts = feature_cuts(source, d)
    width = classes if objective == "softmax" else 1
    mean = source.agg(F.avg("y")).first()[0]
    if mean is None:
        raise ValueError("no rows to fit on")
    base = {"squared": mean, "logistic": float(np.log(max(mean, 1e-12) / max(1 - mean, 1e-12))), "softmax": 0.0}[objective]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, d)
            out = np.empty((b.num_rows, d), np.uint8)
            for f in range(d):
                out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(cuts[f], x[:, f], "left"))
            yield _packed(b, pa.array([r.tobytes() for r in out], pa.binary()), np.full((b.num_rows, width), float(base)))

    schema = "row long, y double, bins binary, margin array<double>"
    table = written(source.mapInArrow(binned, schema), "boosting-bins")
    done: list[list[Tree]] = []
    pending: list[list[Tree]] = []

    def advanced(bins: np.ndarray, margin: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
        for group in trees:
            for k, t in enumerate(group):
                margin[:, k] += np.asarray(t.weight)[t.nodes_of(bins)]
        return margin

    for r in range(p.n_estimators):
        columns = np.sort(np.random.default_rng([p.seed, r]).permutation(d)[:max(1, int(p.colsample_bytree * d))])
        group = _grow(table, [*pending], advanced, objective, width, r, columns, cuts, p)
        done.append(group)
        pending.append(group)
        if len(pending) == SETTLED and r + 1 < p.n_estimators:
            def settle(batches: Iterator[pa.RecordBatch], trees=tuple(pending)) -> Iterator[pa.RecordBatch]:
                for b in (b for b in batches if b.num_rows):
                    bins, margin = _unpacked(b, d)
                    yield _packed(b, b.column("bins"), advanced(bins, margin, trees))
            table, pending = written(table.mapInArrow(settle, schema), "boosting-margins"), []
    return BoostedTrees(objective, [float(base)] * width, done, d)


def _best_splits(table: DataFrame, trees: list[Tree], nodes: list[tuple[int, int]], pending, advanced, objective: str,
                 round_: int, columns: np.ndarray, cuts: list[np.ndarray], p: Params) -> pd.DataFrame:
    """One row per open (class, node) and feature, with its best split and its sums."""
    d, size, place = len(cuts), MISSING + 1, {n: i for i, n in enumerate(nodes)}
    kinds = sorted({k for k, _ in nodes})

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(place), len(columns), size))
        for b in batches:
            used = sampled(b.column("row").to_numpy(), round_, p.subsample, p.seed)
            if not used.any():
                continue
            bins, margin = (v[used] for v in _unpacked(b, d))
            margin, y = advanced(bins, margin, pending), b.column("y").to_numpy(zero_copy_only=False)[used]
            for k in kinds:
                at = np.array([place.get((k, n), -1) for n in range(len(trees[k].feature))])
                node = at[trees[k].nodes_of(bins)]
                live = node >= 0
                g, h = (v[live] for v in gradients(objective, y, margin, k))
                for j, f in enumerate(columns):
                    key = node[live] * size + bins[live, f]
                    for i, w in enumerate((g, h, None)):
                        total[i, :, j, :] += np.bincount(key, w, len(place) * size).reshape(len(place), size)
        node, col, bin_ = np.nonzero(total[2])
        yield pa.RecordBatch.from_pydict({"node": node, "f": col, "bin": bin_, "g": total[0][node, col, bin_],
                                          "h": total[1][node, col, bin_]})

    def splits_of(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (node, col), bins in rows.groupby(["node", "f"]):
            g, h = np.zeros(size), np.zeros(size)
            g[bins["bin"]], h[bins["bin"]] = bins["g"], bins["h"]
            f = int(columns[col])
            n = len(cuts[f]) + 1
            out.append((node, f, *best_split(g[:n], h[:n], (g[MISSING], h[MISSING]), p), g.sum(), h.sum()))
        return pd.DataFrame(out, columns=["node", "f", "gain", "bin", "ml", "gl", "hl", "g", "h"])

    parts = table.mapInArrow(sums_of, "node long, f long, bin long, g double, h double")
    tasks = -(-len(place) * len(columns) // 128)  # histograms of a task
    return parts.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).withColumn(
        "task", (F.col("node") * len(columns) + F.col("f")) % tasks).groupBy("task").applyInPandas(
        splits_of, "node long, f long, gain double, bin long, ml boolean, gl double, hl double, g double, h double").toPandas()


def _grow(table: DataFrame, pending, advanced, objective: str, width: int, round_: int, columns: np.ndarray,
          cuts: list[np.ndarray], p: Params) -> list[Tree]:
    """The trees of all classes, grown together level by level."""
    trees, sums = [Tree() for _ in range(width)], {}
    level = [(k, 0) for k in range(width)]
    at_once = max(1, HISTOGRAMS // len(columns))
    for _ in range(max(p.max_depth, 1)):
        following = []
        for s in range(0, len(level), at_once):
            nodes = level[s:s + at_once]
            best = _best_splits(table, trees, nodes, pending, advanced, objective, round_, columns, cuts, p)
            best = best.sort_values(["node", "gain", "f"], ascending=[True, False, True]).groupby("node").first()
            for i, top in best.iterrows():
                k, n = nodes[int(i)]
                g, h, gl, hl = (float(top[c]) for c in ("g", "h", "gl", "hl"))
                sums[k, n] = (g, h)
                if p.max_depth and top["gain"] > 0:
                    f, b = int(top["f"]), int(top["bin"])
                    kids = trees[k].split(n, f, float(cuts[f][b]), b, bool(top["ml"]), float(top["gain"]))
                    sums[k, kids[0]], sums[k, kids[1]] = (gl, hl), (g - gl, h - hl)
                    following += [(k, x) for x in kids]
        if not (level := following):
            break
    for k, t in enumerate(trees):
        t.prune(p.gamma)
        for n in range(len(t.feature)):
            g, h = sums.get((k, n), (0.0, 0.0))
            t.weight[n] = float(-shrunk(g, p.reg_alpha) / (h + p.reg_lambda + 1e-300) * p.learning_rate)
    return trees


# ------------------------------------------------------------ pipeline stages

class BoostedTreesEstimator(Estimator):
    """The fit as a pipeline stage on a vector column; unknown parameters raise."""

    @keyword_only
    def __init__(self, *, objective="squared", classes=2, featuresCol="features", labelCol="label", params=None):
        super().__init__()
        self.spec = dict(self._input_kwargs)

    def copy(self, extra=None):
        return BoostedTreesEstimator(**self.spec)

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        s = {"objective": "squared", "classes": 2, "featuresCol": "features", "labelCol": "label", **self.spec}
        x = vector_to_array(s["featuresCol"])
        rows = df.select(x.alias("x"), F.col(s["labelCol"]).cast("double").alias("y"))
        width = len(rows.first()["x"])
        model = fit(rows, s["objective"], width, Params(**(s.get("params") or {})), s["classes"])
        return BoostedTreesModel(model, s["featuresCol"])


class BoostedTreesModel(Model, MLReadable, MLWritable):
    def __init__(self, boosted: BoostedTrees, featuresCol: str = "features"):
        super().__init__()
        self.boosted, self.features_col = boosted, featuresCol

    @property
    def featureImportances(self) -> np.ndarray:  # noqa: N802
        from pyspark.ml.linalg import DenseVector
        return DenseVector(self.boosted.importances())

    def _transform(self, df: DataFrame) -> DataFrame:
        boosted = self.boosted

        @F.pandas_udf("array<double>")
        def outputs(x: pd.Series) -> pd.Series:
            return pd.Series(list(boosted.outputs(np.stack(x.to_numpy()).astype(float)))) if len(x) else pd.Series([], dtype=object)
        out = df.withColumn("_outputs", outputs(vector_to_array(self.features_col)))
        if boosted.objective == "squared":
            return out.withColumn("prediction", F.col("_outputs")[0]).drop("_outputs")
        top = F.array_position("_outputs", F.array_max("_outputs")) - 1
        return out.withColumn("probability", array_to_vector("_outputs")).withColumn("prediction", top.cast("double")).drop("_outputs")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        extra = {"boosted": self.model.boosted.to_dict(), "featuresCol": self.model.features_col}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra, paramMap={})


class _Reader(MLReader):
    def load(self, path: str) -> BoostedTreesModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = BoostedTreesModel(BoostedTrees.from_dict(meta["boosted"]), meta["featuresCol"])
        model._resetUid(meta["uid"])
        return model
