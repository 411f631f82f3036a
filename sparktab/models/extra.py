"""Further model operators: k scan and elbow (M34, W3), random search (M35),
linear attribution (M39, O5), learning curve (L4), Fisher LDA (M31),
single-target CCA (M32), NMF (M33), mean shift (M19), random-feature kernel
classifier/regressor (M9, M10) and Platt calibration (M8).

Each fit is a distributed MLlib job or aggregation; the driver only holds
bounded model state (d×d matrices, k centres, a handful of metric rows)."""
from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip_negative
from ..operators import metrics as M
from ..operators import neighbors as N
from ..operators.running import running_sums, sized
from ..operators.split import assign_folds, hash_rank
from ..session import written
from .anomaly import _moments, fourier_features, scatter
from .catalog import SEED
from .train import fold_scores


# ------------------------------------------------------------ k scan

def kmeans_scan(df: DataFrame, vec: str, ks: Sequence[int] = range(2, 11)) -> DataFrame:
    """Inertia and squared-distance silhouette for each k (one distributed
    fit per k on the persisted input)."""
    spark = df.sparkSession
    x = df.select(F.col(vec).cast("array<double>").alias("x")).withColumn("features", array_to_vector("x")).persist()
    dim = len(x.first()["x"])
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=SEED).fit(x)
        pred = m.transform(x).withColumn("c", F.col("prediction").cast("int"))
        sil = M.silhouette_sq(pred, "x", "c", dim).first()["silhouette"]
        rows.append((int(k), float(m.summary.trainingCost), sil))
    x.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def elbow(scan: DataFrame) -> DataFrame:
    """K with the largest second difference of inertia (first on ties),
    and the k with the best silhouette.  The scan has one row per k."""
    w = Window.orderBy("k")
    d2 = scan.select("k", "silhouette", (F.lead("inertia").over(w) - 2 * F.col("inertia")
                                          + F.lag("inertia").over(w)).alias("d2"))
    e = d2.where(F.col("d2").isNotNull()).agg(F.min_by("k", F.struct(-F.col("d2"), F.col("k"))).alias("elbow_k"))
    s = d2.where(F.col("silhouette").isNotNull()).agg(
        F.min_by("k", F.struct(-F.col("silhouette"), F.col("k"))).alias("best_silhouette_k"))
    return e.crossJoin(s)


# --------------------------------------------------------- random search

def random_search(pipeline: Pipeline, estimator, space: dict, df: DataFrame, task: str, key: str,
                  label: str, n_trials: int = 10, folds: int = 5, seed: int = SEED, parallelism: int = 2):
    """Seeded draws from ``space`` (name → (low, high[, 'int'|'log'])
    or list of choices) evaluated by k-fold CV on hash folds; returns
    (best params, table of trials)."""
    rng = random.Random(seed)
    maps = []
    for _ in range(n_trials):
        pm = {}
        for name, spec in space.items():
            p = estimator.getParam(name)
            if isinstance(spec, list):
                pm[p] = rng.choice(spec)
            else:
                lo, hi, *kind = spec
                if kind and kind[0] == "log":
                    pm[p] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
                elif kind and kind[0] == "int":
                    pm[p] = rng.randint(int(lo), int(hi))
                else:
                    pm[p] = rng.uniform(lo, hi)
        maps.append(pm)
    strat = label if task in ("binary_classification", "multiclass_classification") else None
    data = written(assign_folds(df, key, folds, strat), "search-folds")
    ev = (MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label") if strat
          else RegressionEvaluator(metricName="r2", labelCol=label))
    means = fold_scores(pipeline, maps, data, ev, folds, parallelism).mean(axis=0)
    rows = [(i, str({p.name: v for p, v in m.items()}), float(s)) for i, (m, s) in enumerate(zip(maps, means))]
    best = max(range(len(maps)), key=lambda i: (means[i], -i))
    return {p.name: v for p, v in maps[best].items()}, df.sparkSession.createDataFrame(
        rows, "trial int, params string, cv_mean double")


# ------------------------------------------------------- attribution

def linear_attribution(df: DataFrame, features: Sequence[str], coefs: Sequence[float], id_col: str) -> DataFrame:
    """coef_i · (x_i − mean_i) per row and feature (long form)."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    parts = F.array(*[F.struct(F.lit(c).alias("feature"),
                               (F.lit(float(w)) * (F.col(c).cast("double") - F.lit(means[c]))).alias("attribution"))
                      for c, w in zip(features, coefs)])
    return df.select(id_col, F.explode(parts).alias("a")).select(id_col, "a.feature", "a.attribution")


def mean_abs_attribution(attr: DataFrame, top: int = 15) -> DataFrame:
    """Features by mean |attribution| (top N report)."""
    return (attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
            .orderBy(F.desc("mean_abs"), "feature").limit(top))


# ---------------------------------------------------- learning curve (L4)

def learning_curve(df: DataFrame, key: str, features: Sequence[str], label: str, n_sizes: int = 8,
                   folds: int = 3, low: float = 0.1) -> DataFrame:
    """Training-set sizes linspace(low, 1)·n_train per fold; every size is a
    prefix of the fold's hash order; scores are R² of a linear model on the
    train subset and on the held-out fold."""
    spark = df.sparkSession
    ranked = hash_rank(df.select(*dict.fromkeys([key, *features, label])), key).drop("_h")
    f = written(ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")), "learning-rows")
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    rows = []
    for k in range(folds):
        # every ``folds``-th row of the hash order is held out: the others move up by the held-out ones before them
        up = lambda c: F.expr(f"{c} - ({c} + {folds - 1 - k}) div {folds}")
        tr = f.where(F.col("fold") != k).drop("fold").withColumn("_rank", up("_rank")).withColumn("_n", up("_n"))
        te = f.where(F.col("fold") == k)
        for i in range(n_sizes):
            frac = low + i * (1 - low) / (n_sizes - 1)
            sub = tr.where(F.col("_rank") < F.ceil(F.lit(frac) * F.col("_n"))).drop("_rank", "_n")
            m = Pipeline(stages=[asm, LinearRegression(labelCol=label)]).fit(sub)
            a = M.regression_metrics(m.transform(sub), label, "prediction").first()["r2"]
            b = M.regression_metrics(m.transform(te), label, "prediction").first()["r2"]
            rows.append((i, k, float(frac), a, b))
    res = spark.createDataFrame(rows, "size_idx int, fold int, fraction double, train_r2 double, val_r2 double")
    return res.groupBy("size_idx", "fraction").agg(F.avg("train_r2").alias("train_mean"), F.stddev_pop("train_r2").alias("train_std"),
                                                   F.avg("val_r2").alias("val_mean"), F.stddev_pop("val_r2").alias("val_std"))


# ----------------------------------------------------- LDA / CCA

def fisher_lda(df: DataFrame, features: Sequence[str], label: str, n_components: int | None = None):
    """Class means, then centred class scatter; within/between scatter; the
    generalized eigenproblem Sb v = λ Sw v on the driver (d×d).  Returns
    (components k×d, explained variance ratios, overall mean)."""
    feats = list(features)
    d = len(feats)
    x = df.dropna(subset=feats + [label])
    rows = x.groupBy(F.col(label).cast("string").alias("g")).agg(F.count("*").alias("n"), *[
        F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(feats)]).collect()  # one row per class
    means = {r["g"]: np.array([r[f"m{i}"] for i in range(d)], float) for r in rows}
    mu = sum(r["n"] * means[r["g"]] for r in rows) / sum(r["n"] for r in rows)
    Sw = sum(scatter(x, feats, means, label).values())
    Sb = sum(r["n"] * np.outer(means[r["g"]] - mu, means[r["g"]] - mu) for r in rows)
    w, V = np.linalg.eig(np.linalg.pinv(Sw) @ Sb)
    w, V = np.real(w), np.real(V)
    order = np.argsort(w)[::-1]
    k = min(n_components or len(rows) - 1, len(rows) - 1, d)
    w, V = w[order][:k], V[:, order][:, :k].T
    ratio = w / w.sum() if w.sum() > 0 else w
    return V, ratio, mu


def cca_single_target(df: DataFrame, features: Sequence[str], target: str):
    """One canonical pair: a ∝ Sxx⁻¹ sxy; canonical correlation
    ρ = √(syxᵀ Sxx⁻¹ sxy / syy); loadings = corr(x_i, Xa)."""
    cols = list(features) + [target]
    mu, S = _moments(df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna(), cols)
    Sxx, sxy, syy = S[:-1, :-1], S[:-1, -1], S[-1, -1]
    a = np.linalg.pinv(Sxx) @ sxy
    rho = math.sqrt(max(float(sxy @ a) / syy, 0.0)) if syy > 0 else 0.0
    var_u = float(a @ Sxx @ a)
    load = (Sxx @ a) / np.sqrt(np.diag(Sxx) * var_u) if var_u > 0 else np.zeros(len(features))
    return a, rho, load


# ------------------------------------------------------------- NMF

def nmf(df: DataFrame, features: Sequence[str], id_col: str, k: int = 5, max_iter: int = 200):
    """Clipped values melted to (row, column, value) and factorised by
    non-negative ALS; returns (row factors W, column factors H as a k×d
    array, reconstruction RMSE)."""
    feats = list(features)
    ix = {c: i for i, c in enumerate(feats)}
    clipped = df.select(F.col(id_col).cast("int").alias("row"),
                        F.explode(F.array(*[F.struct(F.lit(ix[c]).alias("col"),
                                                     clip_negative(F.col(c).cast("double")).alias("v"))
                                            for c in feats])).alias("e")).select("row", "e.col", "e.v").where("v is not null")
    als = ALS(rank=k, maxIter=max_iter, regParam=0.0, nonnegative=True, userCol="row", itemCol="col",
              ratingCol="v", seed=SEED, coldStartStrategy="drop")
    m = als.fit(clipped)
    H = np.zeros((k, len(feats)))
    for r in m.itemFactors.collect():  # d rows
        H[:, r["id"]] = r["features"]
    rmse = RegressionEvaluator(metricName="rmse", labelCol="v").evaluate(m.transform(clipped))
    return m.userFactors, H, rmse


def nmf_transform(df: DataFrame, features: Sequence[str], H: np.ndarray, n_iter: int = 200) -> DataFrame:
    """New rows against fixed H: multiplicative updates per row in Arrow
    batches (row-local work, no shuffle)."""
    feats = list(features)
    k = H.shape[0]
    from pyspark.sql import types as T
    schema = T.StructType(list(df.schema.fields) + [T.StructField("nmf", T.ArrayType(T.DoubleType()))])
    HHt = H @ H.T

    def run(batches):
        for pdf in batches:
            X = np.clip(pdf[feats].to_numpy(dtype=float), 0, None)
            W = np.full((len(X), k), 0.5)
            num = X @ H.T
            for _ in range(n_iter):
                W *= num / np.maximum(W @ HHt, 1e-12)
            yield pdf.assign(nmf=list(W))
    return df.mapInPandas(run, schema)


# ------------------------------------------------------- mean shift

def mean_shift(points: DataFrame, vec: str, id_col: str, bandwidth: float,
               tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Flat-kernel mean shift with bin seeding: seeds are occupied grid cells
    of side ``bandwidth``; every round moves each seed to the mean of the points
    within ``bandwidth`` and drops seeds that meet, until no seed moves more than
    ``tolerance`` bandwidths; of centres closer than ``bandwidth`` the denser stays
    (ties by coordinates); points take the nearest centre.  Seeds are tables
    throughout.  The bandwidth must be given.  Returns (labels, centres)."""
    x = written(points.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")),
                "mean-shift-points")
    seeds = x.select(F.transform("v", lambda t: F.round(t / bandwidth) * bandwidth).alias("v")).distinct()
    while True:
        seeds = written(seeds.select("v").withColumn("id", F.monotonically_increasing_id()), "seeds")
        moved = written(_window_means(seeds, x, bandwidth), "moved-seeds")
        if (moved.agg(F.max("shift")).first()[0] or 0.0) < tolerance * bandwidth:
            break
        seeds = moved.select("v").distinct()
    # seeds that ended in one place up to the tolerance stand for one centre
    spot = F.transform("v", lambda t: F.round(t / (tolerance * bandwidth)))
    ends = moved.groupBy(spot.alias("spot")).agg(F.max(F.struct("n", "v")).alias("e"))
    ends = written(ends.select(F.monotonically_increasing_id().alias("id"), "e.n", "e.v"), "mean-shift-ends")
    centers = _denser(ends, bandwidth)
    lab = N.knn_join(x, centers, 1, "id", "id", "v", "v").select(F.col("qid").alias(id_col), F.col("rid").cast("int").alias("cluster"))
    return lab, centers


def _denser(ends: DataFrame, bandwidth: float) -> DataFrame:
    """(id, v) of the centres that stay when they are taken from the densest on and
    none may lie closer than ``bandwidth`` to one taken before; numbered from 0."""
    q = ends.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    r = ends.select(F.col("id").alias("rid"), F.col("v").alias("rv"))

    def close(qp, rp):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(qp) and len(rp):
            qi, ri = qp["qid"].to_numpy(np.int64), rp["rid"].to_numpy(np.int64)
            for s, D in N._pairs(qp, rp):
                i, j = np.nonzero(D < bandwidth)
                out.append((qi[s + i], ri[j]))
        a, b = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    rank = ends.select("id", F.struct(-F.col("n"), "v", "id").alias("rank"))
    pairs = N._met(*N._on_grid(q, r, bandwidth), N.GRID, N.BLOCK_ROWS, close, "a long, b long")
    pairs = pairs.join(rank.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a") \
        .join(rank.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b").where("rb < ra").select("a", "b")
    pairs = written(pairs, "denser-neighbours")  # b is denser than a
    state = written(rank.select("id", F.lit("open").alias("state")), "centre-state")
    while not state.where("state = 'open'").isEmpty():
        near = pairs.join(state.select(F.col("id").alias("b"), "state"), "b").groupBy(F.col("a").alias("id")).agg(
            F.max((F.col("state") == "kept").cast("int")).alias("kept"), F.max((F.col("state") == "open").cast("int")).alias("open"))
        now = F.when(F.col("state") != "open", F.col("state")).when(F.col("kept") == 1, "gone") \
            .when(F.coalesce("open", F.lit(0)) == 0, "kept").otherwise("open")
        state = written(state.join(near, "id", "left").select("id", now.alias("state")), "centre-state")
    kept = ends.join(state.where("state = 'kept'").select("id"), "id").withColumn("_one", F.lit(1)) \
        .withColumn("_less", -F.col("n"))
    table, n = sized(kept)
    return running_sums(table, [], ["_less", "v"], ["_one"], n_rows=n).select(
        (F.col("cum__one") - 1).cast("long").alias("id"), "v")


def _window_means(seeds: DataFrame, pts: DataFrame, bw: float) -> DataFrame:
    """(v, n, shift): where each seed moves, over how many points, and how far."""
    q = seeds.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    r = pts.select(F.col("id").alias("rid"), F.col("v").alias("rv"))

    def kernel(qp, rp):
        Q = N._stack(qp["qv"])
        sums, cnt = np.zeros_like(Q), np.zeros(len(Q), dtype=np.int64)
        if len(qp) and len(rp):
            R = N._stack(rp["rv"])
            for s, D in N._pairs(qp, rp):
                m = D <= bw
                sums[s:s + len(D)] = m.astype(float) @ R
                cnt[s:s + len(D)] = m.sum(axis=1)
        return pd.DataFrame({"qid": qp["qid"].to_numpy(np.int64), "s": list(sums), "n": cnt})

    part = N._met(*N._on_grid(q, r, bw), N.GRID, N.BLOCK_ROWS, kernel, "qid long, s array<double>, n long")
    first = pts.first()
    dim = len(first["v"]) if first else 0
    mean = part.groupBy("qid").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s"),
                                   F.sum("n").alias("n")).where("n > 0")
    to = F.transform("s", lambda t: t / F.col("n"))
    gap = F.sqrt(F.aggregate(F.zip_with("v", "qv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    return mean.select("qid", "n", to.alias("v")).join(q, "qid").select("v", "n", gap.alias("shift"))


# ------------------------------------------------ kernel models

def platt_calibrated_svc(train: DataFrame, features: Sequence[str], label: str, key: str,
                         folds: int = 3, reg: float = 1e-4):
    """M8 (binary): LinearSVC margins computed out of fold (hash folds),
    a logistic regression on the margin maps them to probabilities; the
    final SVC is fitted on all rows.  Returns (svc model, calibrator)."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features")
    rows = train.select(*dict.fromkeys([key, label, *features]))
    data = asm.transform(written(assign_folds(rows, key, folds), "calibration-folds"))
    oof = None
    for k in range(folds):
        m = LinearSVC(labelCol=label, regParam=reg).fit(data.where(F.col("fold") != k))
        part = m.transform(data.where(F.col("fold") == k)).select(
            label, vector_to_array("rawPrediction")[1].alias("margin"))
        oof = part if oof is None else oof.unionByName(part)
    cal = LogisticRegression(labelCol=label, featuresCol="mv").fit(
        VectorAssembler(inputCols=["margin"], outputCol="mv").transform(oof))
    return LinearSVC(labelCol=label, regParam=reg).fit(data), cal


def kernel_classifier(train: DataFrame, features: Sequence[str], label: str, n_components: int = 100,
                      reg: float = 1e-4, multiclass: bool = False):
    """M9 (re-aimed RBF SVC): random Fourier features + linear SVM."""
    z, params = fourier_features(train, features, n_components)
    z = z.withColumn("features", array_to_vector("rff"))
    svc = LinearSVC(labelCol=label, regParam=reg)
    est = OneVsRest(classifier=svc, labelCol=label, parallelism=4) if multiclass else svc
    return est.fit(z), params


def kernel_regressor(train: DataFrame, features: Sequence[str], label: str, n_components: int = 100,
                     reg: float = 1e-4):
    """M10 (re-aimed RBF SVR): random Fourier features + Huber regression."""
    z, params = fourier_features(train, features, n_components)
    z = z.withColumn("features", array_to_vector("rff"))
    return LinearRegression(labelCol=label, loss="huber", regParam=reg, elasticNetParam=0.0).fit(z), params


# ------------------------------------------- Monte-Carlo Shapley

def mc_shapley(model, df: DataFrame, features: Sequence[str], id_col: str, baseline: dict,
               n_perm: int = 8, seed: int = SEED, output: str = "prediction",
               assembler_out: str = "features") -> DataFrame:
    """Permutation-sampling Shapley values with a fixed baseline: every row
    expands to n_perm × (d+1) coalition states (seeded orderings), the model
    scores them in bulk, consecutive differences along each ordering credit
    the feature that entered, and the mean over orderings is the value.
    Rows that share an id share their mean.  A state counts for the feature that entered
    last and against the next one, so sums per (id, feature) are all that is shuffled.
    Returns (id, feature, attribution); rows × n_perm × (d+1) is linear."""
    feats = list(features)
    d = len(feats)
    fx = F.array(*[F.struct(F.lit(i).alias("f"), F.xxhash64(F.lit(seed), F.col("_p"), F.col(id_col), F.lit(i)).alias("h"))
                   for i in range(d)])
    perm = F.transform(F.array_sort(fx, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)),
                       lambda e: e["f"])
    x = (df.select(id_col, *feats).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
         .withColumn("_perm", perm).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(d)))))
    # feature i is "in" when its position in the ordering is < j
    enter = F.when(F.col("_j") > 0, F.element_at("_perm", F.greatest(F.col("_j"), F.lit(1))))
    after = F.when(F.col("_j") < d, F.element_at("_perm", F.least(F.col("_j") + 1, F.lit(d))))
    states = x.select(id_col, enter.alias("_enter"), after.alias("_next"),
                      *[F.when(F.array_position("_perm", i) - 1 < F.col("_j"), F.col(c).cast("double"))
                        .otherwise(F.lit(float(baseline[c]))).alias(c) for i, c in enumerate(feats)])
    scored = model.transform(states)
    val = vector_to_array("probability")[1] if output == "probability" else F.col("prediction")
    s = scored.select(id_col, "_enter", "_next", val.alias("_v"))
    parts = F.array(F.struct(F.col("_enter").alias("feat_ix"), F.col("_v").alias("delta"), F.lit(1).alias("entered")),
                    F.struct(F.col("_next").alias("feat_ix"), (-F.col("_v")).alias("delta"), F.lit(0).alias("entered")))
    diffs = s.select(id_col, F.inline(parts)).where(F.col("feat_ix").isNotNull())
    names = F.array(*[F.lit(c) for c in feats])
    return diffs.groupBy(id_col, "feat_ix").agg((F.sum("delta") / F.sum("entered")).alias("attribution")).select(
        id_col, F.element_at(names, F.col("feat_ix") + 1).alias("feature"), "attribution")
