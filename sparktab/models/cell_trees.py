"""MLlib's forests and squared-error boosting on many rows, grown from sums per cell.

A split only asks in which bin of a feature a row lies, so the rows of one cell (one bin of
every feature) never part, and a tree needs no more of them than their sums.  MLlib passes over
all rows and trees once a level (and a round); here one pass draws every tree's rows and
adds them up per cell, and trees are grown from the cells in parallel.  Bins, draws, gains,
stopping and pruning are MLlib's; cuts are quantiles of all rows, not of a sample of them, and
draws come from other random numbers, so figures move as they do with the layout of the rows.
What comes back is MLlib's own model, loaded from the node table it would have saved.

Fits of at most ``ROWS`` rows, of more possible cells than ``CELLS``, or that ask for what
is not told by sums (weights, categories, other losses) are left to MLlib."""
from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, shuffle_partitions

#: Rows up to which MLlib fits.
ROWS = 1_000_000
#: Possible cells of a classification, whose class counts stand for its rows, and of a regression, with sums per tree.
CELLS = {"gini": 1 << 20, "variance": 1 << 15}
#: Cells of one task's sums of all its trees at most, some 100 MB.
SUMS = 1 << 22
#: Rows that a task adds up at once.
BLOCK = 1 << 17
EPSILON = 2.0 ** -52
NODES = ("tree int, id int, prediction double, impurity double, stats array<double>, n long, gain double, "
         "left int, right int, feature int, cut double")


# ------------------------------------------------------------ one tree

def _impurity(stats: np.ndarray, kind: str) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "gini":
            n = stats.sum(-1)
            out = 1.0 - ((stats / n[..., None]) ** 2).sum(-1)
        else:
            n = stats[..., 0]
            out = (stats[..., 2] - stats[..., 1] * stats[..., 1] / n) / n
    return np.where(n > 0, out, 0.0)


def _count(stats: np.ndarray, kind: str) -> np.ndarray:
    return stats.sum(-1) if kind == "gini" else stats[..., 0]


def grow(bins: np.ndarray, stats: np.ndarray, n_bins: list[int], kind: str, depth: int, least_rows: int, least_gain: float,
         subset: Callable[[int], np.ndarray] | None = None) -> tuple[list[dict], np.ndarray]:
    """(nodes with children after their parent, value of every cell) of the tree over cells.

    ``stats`` are class counts (gini) or count, sum and sum of squares (variance) of a cell's
    drawn rows; ``subset`` gives the features that each of so many nodes may split on."""
    def node(s: np.ndarray, impurity: float) -> dict:
        value = float(s.argmax()) if kind == "gini" else float(s[1] / s[0])
        return {"stats": s, "impurity": float(impurity), "prediction": value, "feature": -1, "bin": 0, "gain": -1.0, "left": -1, "right": -1}

    whole = stats.sum(0)
    nodes, owner = [node(whole, _impurity(whole, kind))], np.zeros(len(bins), np.int64)
    live, level = [0], 0
    while live and level < depth:
        m, width = len(live), stats.shape[1]
        place = np.full(len(nodes), -1)
        place[live] = np.arange(m)
        here = place[owner]
        rows = np.flatnonzero(here >= 0)
        at, own, total = here[rows], stats[rows], np.stack([nodes[i]["stats"] for i in live])
        before = np.array([nodes[i]["impurity"] for i in live])
        gains, cuts, lefts = np.full((m, len(n_bins)), -np.inf), np.zeros((m, len(n_bins)), int), np.zeros((m, len(n_bins), width))
        for f, size in enumerate(n_bins):
            if size < 2:
                continue
            key = at * size + bins[rows, f]
            left = np.stack([np.bincount(key, own[:, s], m * size).reshape(m, size) for s in range(width)], 2).cumsum(1)[:, :-1]
            right = total[:, None] - left
            nl, nr = _count(left, kind), _count(right, kind)
            gain = before[:, None] - nl / (nl + nr) * _impurity(left, kind) - nr / (nl + nr) * _impurity(right, kind)
            gain = np.where((nl >= least_rows) & (nr >= least_rows) & (gain >= least_gain), gain, -np.inf)
            cuts[:, f] = gain.argmax(1)
            gains[:, f] = gain[np.arange(m), cuts[:, f]]
            lefts[:, f] = left[np.arange(m), cuts[:, f]]
        if subset is not None:
            gains[~subset(m)] = -np.inf
        best = gains.argmax(1)
        feature, cut, to, following = np.full(m, -1), np.zeros(m, int), np.zeros((m, 2), int), []
        level += 1
        for i, n in enumerate(live):
            f = int(best[i])
            if not gains[i, f] > 0:
                continue
            kids = [lefts[i, f], total[i] - lefts[i, f]]
            feature[i], cut[i], to[i] = f, cuts[i, f], (len(nodes), len(nodes) + 1)
            nodes[n].update(feature=f, bin=int(cuts[i, f]), gain=float(gains[i, f]), left=len(nodes), right=len(nodes) + 1)
            for s in kids:
                impurity = float(_impurity(s, kind))
                if abs(impurity) >= EPSILON:
                    following.append(len(nodes))
                nodes.append(node(s, impurity))
        split = feature[at] >= 0
        rows, at = rows[split], at[split]
        owner[rows] = np.where(bins[rows, feature[at]] <= cut[at], to[at, 0], to[at, 1])
        live = following
    value = np.array([n["prediction"] for n in nodes])[owner]
    return nodes, value


def node_frame(tree: int, nodes: list[dict], cuts: list[np.ndarray], kind: str) -> pd.DataFrame:
    """Rows of ``NODES``; splits whose leaves agree are taken back, as MLlib does."""
    for n in reversed(nodes):  # children stand after their parent
        if n["feature"] >= 0:
            a, b = nodes[n["left"]], nodes[n["right"]]
            if a["feature"] < 0 and b["feature"] < 0 and a["prediction"] == b["prediction"]:
                n.update(feature=-1, gain=-1.0, left=-1, right=-1, prediction=a["prediction"])
    kept = [0]
    for i in kept:
        if nodes[i]["feature"] >= 0:
            kept += [nodes[i]["left"], nodes[i]["right"]]
    number = {i: k for k, i in enumerate(kept)} | {-1: -1}
    out = [nodes[i] for i in kept]
    return pd.DataFrame({
        "tree": tree, "id": range(len(out)), "prediction": [n["prediction"] for n in out], "impurity": [n["impurity"] for n in out],
        "stats": [n["stats"] for n in out], "n": [round(float(_count(n["stats"], kind))) for n in out], "gain": [n["gain"] for n in out],
        "left": [number[n["left"]] for n in out], "right": [number[n["right"]] for n in out], "feature": [n["feature"] for n in out],
        "cut": [float(cuts[n["feature"]][n["bin"]]) if n["feature"] >= 0 else 0.0 for n in out]})


# ------------------------------------------------------------ cuts, cells, draws

def feature_cuts(rows: DataFrame, d: int, most: int, kinds: list[int], quantiles: list[list[float]]) -> list[np.ndarray]:
    """Cuts of every feature: the middles between its values if there are at most ``most``, else quantiles."""
    cuts = [np.unique(np.asarray(q, float)) for q in quantiles]
    for f in (f for f in range(d) if kinds[f] <= 2 * most):  # the estimate is off by some percent
        values = np.array(sorted(r[0] for r in rows.select(F.col("x")[f]).distinct().collect()))
        if len(values) <= most:
            cuts[f] = (values[1:] + values[:-1]) / 2
    return cuts


def draw_cdf(rate: float, bootstrap: bool) -> np.ndarray:
    """Chances of a row being drawn at most 0, 1, ... times: Poisson with replacement, else once or not."""
    if not bootstrap:
        return np.array([1.0 - rate, 1.0])
    p = [math.exp(-rate)]
    while p[-1] > 1e-18 or len(p) <= rate:
        p.append(p[-1] * rate / len(p))
    return np.append(np.minimum(np.cumsum(p), 1.0)[:-1], 1.0)


def drawn(rng: np.random.Generator, n: int, cdf: np.ndarray, table: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """How often each of n rows is drawn: sixteen bits decide nearly all, more bits the others."""
    u = rng.integers(0, 1 << 16, n, dtype=np.uint16)
    out = table[u]
    (at,) = np.nonzero(open_[u])
    out[at] = np.searchsorted(cdf, (u[at] + rng.random(len(at))) / (1 << 16), "right")
    return out


def draw_table(cdf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws by the leading sixteen bits, and where these alone do not tell."""
    edge = np.arange((1 << 16) + 1) / (1 << 16)
    low, high = np.searchsorted(cdf, edge[:-1], "right"), np.searchsorted(cdf, np.nextafter(edge[1:], 0), "right")
    return np.minimum(low, len(cdf) - 1).astype(float), low != high


def cells_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    cell = np.zeros(len(x), np.int64)
    for f, c in enumerate(cuts):
        cell = cell * (len(c) + 1) + np.searchsorted(c, x[:, f], "left")
    return cell


def bins_of(cell: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(cell), len(cuts)), np.int64)
    for f in reversed(range(len(cuts))):
        cell, out[:, f] = np.divmod(cell, len(cuts[f]) + 1)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first row, cells, labels) of some ``BLOCK`` rows at a time."""
    held, first, n = [], None, 0

    def joined():
        return first, np.concatenate([c for c, _ in held]), np.concatenate([y for _, y in held])
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        first = b.column("row")[0].as_py() if first is None else first
        held.append((cells_of(x, cuts), b.column("y").to_numpy(zero_copy_only=False)))
        n += b.num_rows
        if n >= BLOCK:
            yield joined()
            held, first, n = [], None, 0
    if held:
        yield joined()


def class_counts(rows: DataFrame, cuts: list[np.ndarray], classes: int) -> pd.DataFrame:
    """(cell, class, n) of all rows: at most one row a cell and class, whatever the size of the table."""
    size = math.prod(len(c) + 1 for c in cuts) * classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, cell, y in _blocks(batches, cuts):
            total += np.bincount(cell * classes + y.astype(np.int64), minlength=size)
        (at,) = np.nonzero(total)
        for s in range(0, len(at), BLOCK):
            a = at[s:s + BLOCK]
            yield pa.RecordBatch.from_pydict({"cell": a // classes, "class": a % classes, "n": total[a]})

    parts = rows.mapInArrow(run, "cell long, class long, n long").groupBy("cell", "class").agg(F.sum("n").alias("n"))
    return parts.toArrow().to_pandas().sort_values(["cell", "class"], ignore_index=True)


def drawn_sums(rows: DataFrame, cuts: list[np.ndarray], trees: int, rate: float, bootstrap: bool, seed: int) -> DataFrame:
    """(tree, cell, n, s, ss): count, sum and sum of squares of the labels that each tree draws."""
    size, cdf = math.prod(len(c) + 1 for c in cuts), draw_cdf(rate, bootstrap)
    at_once = max(1, SUMS // (3 * size))
    all_rows = not bootstrap and rate >= 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, open_ = draw_table(cdf)
        total = np.zeros((trees, 3, size))
        for first, cell, y in _blocks(batches, cuts):
            square = y * y
            rng = np.random.default_rng([seed & 0xFFFFFFFF, first])
            for t in range(trees):
                w = np.ones(len(y)) if all_rows else drawn(rng, len(y), cdf, table, open_)
                total[t, 0] += np.bincount(cell, w, size)
                total[t, 1] += np.bincount(cell, w * y, size)
                total[t, 2] += np.bincount(cell, w * square, size)
        for t in range(0, trees, at_once):
            tree, at = np.nonzero(total[t:t + at_once, 0])
            yield pa.RecordBatch.from_pydict({"tree": tree + t, "cell": at, **{
                k: total[t + tree, i, at] for i, k in enumerate(("n", "s", "ss"))}})

    parts = rows.mapInArrow(run, "tree long, cell long, n double, s double, ss double")
    return parts.groupBy("tree", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])


def subset_size(strategy: str, d: int, trees: int, kind: str) -> int:
    """Features that a node may split on."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if kind == "gini" else "onethird"
    named = {"all": d, "sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d))), "onethird": math.ceil(d / 3)}
    if strategy in named:
        return named[strategy]
    return min(d, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * d)


def _subsets(rng: np.random.Generator, d: int, k: int) -> Callable[[int], np.ndarray] | None:
    return None if k >= d else lambda m: rng.random((m, d)).argsort(1).argsort(1) < k


# ------------------------------------------------------------ the fits

class CellTrees(Estimator):
    """A forest or squared-error boosted regression of MLlib, fitted from sums per cell where rows are many."""

    def __init__(self, mllib, rows: int = ROWS):
        super().__init__()
        self.mllib, self.rows = mllib, rows

    def copy(self, extra=None):
        return CellTrees(self.mllib.copy(extra), self.rows)

    def _fit(self, df: DataFrame):
        return _fitted(df, self.mllib, self.rows) or self.mllib.fit(df)


def _fitted(df: DataFrame, est, most_rows: int):
    """The fitted model, or None where the fit is left to MLlib."""
    boosted, kind = isinstance(est, R.GBTRegressor), "gini" if isinstance(est, C.RandomForestClassifier) else "variance"
    p = {param.name: value for param, value in est.extractParamMap().items()}
    if p["impurity"] != kind or p.get("weightCol") or p["minWeightFractionPerNode"] or p.get("lossType", "squared") != "squared" \
            or p.get("validationIndicatorCol") or not isinstance(est, (C.RandomForestClassifier, R.RandomForestRegressor, R.GBTRegressor)):
        return None
    attrs = df.schema[p["featuresCol"]].metadata.get("ml_attr", {}).get("attrs", {})
    if "nominal" in attrs or "binary" in attrs or df.count() <= most_rows:
        return None
    rows = df.select(vector_to_array(p["featuresCol"]).alias("x"), F.col(p["labelCol"]).cast("double").alias("y"))
    d = len((rows.first()["x"]) or ())
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    shares = [float(s) for s in np.arange(1, p["maxBins"]) / p["maxBins"]]
    seen = rows.agg(F.coalesce(F.bool_or(F.col("x").isNull() | (F.size("x") != d) | F.exists("x", odd) | odd(F.col("y"))), F.lit(True)), F.max("y"),
                    F.bool_or((F.col("y") < 0) | (F.floor("y") != F.col("y"))),
                    F.array(*[F.approx_count_distinct(F.col("x")[f]) for f in range(d)]),
                    F.array(*[F.percentile_approx(F.col("x")[f], shares, 10_000) for f in range(d)])).first() if d else None
    if seen is None or seen[0] or (kind == "gini" and seen[2]):
        return None  # MLlib says what is wrong with them
    cuts = feature_cuts(rows, d, p["maxBins"], seen[3], seen[4])
    trees = p["maxIter"] if boosted else p["numTrees"]
    n_bins = [len(c) + 1 for c in cuts]
    cells = math.prod(n_bins)
    if cells > CELLS[kind] or (kind == "variance" and 3 * cells * trees > 4 * SUMS):
        return None
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    seed, rate = p["seed"], p["subsamplingRate"]
    limits = (p["maxDepth"], p["minInstancesPerNode"], p["minInfoGain"])
    features = subset_size(p["featureSubsetStrategy"], d, 1 if boosted else trees, kind)
    extra = {"numFeatures": d, "numTrees": trees}
    spark = df.sparkSession
    if kind == "gini":
        label = df.schema[p["labelCol"]].metadata.get("ml_attr", {})
        extra["numClasses"] = classes = len(label["vals"]) if "vals" in label else int(label.get("num_vals", 0)) or int(seen[1]) + 1
        if seen[1] >= classes:
            return None
        counts = class_counts(rows, cuts, classes)
        cell, at = np.unique(counts["cell"].to_numpy(), return_inverse=True)
        held = spark.sparkContext.broadcast((bins_of(cell, cuts), at, counts["class"].to_numpy(), counts["n"].to_numpy()))

        def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bins, at, cls, n = held.value
            for tree in (int(t) for b in batches for t in b["id"]):
                rng = np.random.default_rng([seed & 0xFFFFFFFF, tree])
                w = rng.poisson(rate * n) if p["bootstrap"] else rng.binomial(n, rate)
                stats = np.zeros((len(bins), classes))
                stats[at, cls] = w
                some = stats.sum(1) > 0
                nodes, _ = grow(bins[some], stats[some], n_bins, kind, *limits, _subsets(rng, d, features))
                yield node_frame(tree, nodes, cuts, kind)
        nodes = spark.range(0, trees, 1, min(trees, max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism))).mapInPandas(forest, NODES)
        return _loaded(df, est, nodes, extra, [1.0] * trees)

    sums = drawn_sums(rows, cuts, trees, rate, not boosted and p["bootstrap"], seed)

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        part, t = part.sort_values("cell"), int(part["tree"].iloc[0])
        rng = np.random.default_rng([seed & 0xFFFFFFFF, t])
        nodes, _ = grow(bins_of(part["cell"].to_numpy(), cuts), part[["n", "s", "ss"]].to_numpy(), n_bins, kind, *limits, _subsets(rng, d, features))
        return node_frame(t, nodes, cuts, kind)

    def rounds(part: pd.DataFrame) -> pd.DataFrame:
        cell, at = np.unique(part["cell"].to_numpy(), return_inverse=True)
        bins, value, out = bins_of(cell, cuts), np.zeros(len(cell)), []
        total = np.zeros((trees, len(cell), 3))
        total[part["tree"].to_numpy(), at] = part[["n", "s", "ss"]].to_numpy()
        for t in range(trees):
            n, s, ss = total[t].T
            if t:  # twice the residuals, the negative gradients of the squared error
                s, ss = 2 * (s - value * n), 4 * (ss - 2 * value * s + value * value * n)
            rng = np.random.default_rng([seed & 0xFFFFFFFF, t])
            nodes, gain = grow(bins, np.stack([n, s, ss], 1), n_bins, kind, *limits, _subsets(rng, d, features))
            value = value + (p["stepSize"] if t else 1.0) * gain
            out.append(node_frame(t, nodes, cuts, kind))
        return pd.concat(out)

    if boosted:  # rounds follow each other; what they need is bounded by cells and rounds
        nodes = sums.groupBy(F.lit(0).alias("one")).applyInPandas(rounds, NODES)
        return _loaded(df, est, nodes, extra, [1.0] + [float(p["stepSize"])] * (trees - 1))
    return _loaded(df, est, sums.groupBy("tree").applyInPandas(tree, NODES), extra, [1.0] * trees)


def _loaded(df: DataFrame, est, nodes: DataFrame, extra: dict, weights: list[float]):
    """MLlib's model of the trees, by way of the tables in which it saves one."""
    kind = type(est).__name__
    whole = {"RandomForestClassifier": C.RandomForestClassificationModel, "RandomForestRegressor": R.RandomForestRegressionModel,
             "GBTRegressor": R.GBTRegressionModel}[kind]
    single = f"{'classification.DecisionTreeClassification' if 'numClasses' in extra else 'regression.DecisionTreeRegression'}Model"
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"cell-trees-{uuid.uuid4().hex}")
    est.write().save(f"{path}-params")
    meta = json.loads(spark.read.text(f"{path}-params/metadata").first()[0])
    of_tree = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
               "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "probabilityCol", "rawPredictionCol", "seed"}
    own = [meta | {"class": f"org.apache.spark.ml.{single}", "uid": f"{'dtc' if 'numClasses' in extra else 'dtr'}_{uuid.uuid4().hex[-12:]}"}
           | {k: {n: v for n, v in meta[k].items() if n in of_tree} for k in ("paramMap", "defaultParamMap")} for _ in weights]
    own = [m | {k: extra[k] for k in ("numFeatures", "numClasses") if k in extra} for m in own]
    meta |= {"class": f"org.apache.spark.ml.{'classification' if 'numClasses' in extra else 'regression'}.{whole.__name__}"} | extra
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, json.dumps(m), w) for i, (m, w) in enumerate(zip(own, weights, strict=True))],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    leaf = F.col("feature") < 0
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("cut")).alias(
        "leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    data = F.struct("id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("n").alias("rawCount"), "gain",
                    F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
    nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")
    return whole.load(path)
