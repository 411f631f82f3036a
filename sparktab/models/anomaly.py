"""Anomaly detectors without a built-in MLlib twin.

Isolation forest: every tree draws its own ≈256-row subsample with a seeded
xxhash of (tree, id) — one pass, no per-tree copy of the table — trees are
grown in parallel with ``groupBy(tree).applyInPandas`` (one 256-row group per
tree) and the fitted forest (trees × ≤ 511 nodes, a bounded model) scores
rows in Arrow batches with ``mapInPandas``.
Elliptic envelope: concentration steps of a robust covariance, each one a
Gram aggregate over the kept rows and an exact distance quantile.
Kernel novelty: random Fourier features, distance to their mean.
All scores follow the convention higher = more anomalous."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import fitted_quantiles

EULER_GAMMA = 0.5772156649015329
MAX_SAMPLES = 256
AUTO_THRESHOLD = 0.5  # fixed value: 'auto' contamination offset of the forest


def _c(n: np.ndarray | float):
    """Average path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        k = len(feat)
        feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return k
        Xi = X[idx]
        lo, hi = Xi.min(axis=0), Xi.max(axis=0)
        cand = np.nonzero(hi > lo)[0]
        if len(cand) == 0:
            return k
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[k], thr[k] = f, t
        mask = Xi[:, f] < t
        left[k] = node(idx[mask], depth + 1)
        right[k] = node(idx[~mask], depth + 1)
        return k

    node(np.arange(len(X)), 0)
    return feat, thr, left, right, size


def _path_lengths(X: np.ndarray, tree) -> np.ndarray:
    feat, thr, left, right, size = (np.asarray(a) for a in tree)
    cur = np.zeros(len(X), dtype=int)
    depth = np.zeros(len(X))
    active = feat[cur] >= 0
    while active.any():
        f = feat[cur[active]]
        go_left = X[active, f] < thr[cur[active]]
        nxt = np.where(go_left, left[cur[active]], right[cur[active]])
        cur[active] = nxt
        depth[active] += 1
        active = feat[cur] >= 0
    return depth + _c(size[cur])


class IsolationForestModel:
    def __init__(self, trees, psi: int, features: Sequence[str], threshold: float):
        self.trees, self.psi, self.features, self.threshold = trees, psi, list(features), threshold

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``anomaly_score`` (2^(−E[h]/c(ψ)) − 0.5) and ``is_anomaly``."""
        trees, cpsi, feats = self.trees, float(_c(np.array([self.psi]))[0]), self.features
        from pyspark.sql import types as T
        schema = T.StructType(list(df.schema.fields) + [T.StructField("anomaly_score", T.DoubleType())])

        def run(batches):
            for pdf in batches:
                X = pdf[feats].to_numpy(dtype=float)
                h = np.mean([_path_lengths(X, t) for t in trees], axis=0) if len(X) else np.zeros(0)
                s = np.power(2.0, -h / cpsi) if cpsi > 0 else np.full(len(X), 0.5)
                yield pdf.assign(anomaly_score=s - AUTO_THRESHOLD)
        out = df.mapInPandas(run, schema)
        return out.withColumn("is_anomaly", (F.col("anomaly_score") > F.lit(self.threshold)).cast("int"))


def isolation_forest(train: DataFrame, features: Sequence[str], id_col: str, n_estimators: int = 100,
                     max_samples: int = MAX_SAMPLES, contamination="auto", seed: int = 42) -> IsolationForestModel:
    """Isolation forest; threshold 0 (score 0.5) for 'auto', else the
    training score at the 1 − contamination quantile."""
    n = train.count()
    psi = int(min(max_samples, n))
    rate = min(1.0, 3.0 * psi / max(n, 1))
    cut = max(1, int(rate * 2 ** 62))
    x = train.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in features])
    trees_of_row = F.filter(F.sequence(F.lit(0), F.lit(n_estimators - 1)),
                            lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col("_id")), 2) < F.lit(cut))
    picked = x.withColumn("tree", F.explode(trees_of_row))
    w = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 1), F.col("tree"), F.col("_id")), "_id")
    sample = picked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    feats = list(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100_003 + t)
        X = pdf.sort_values("_id")[feats].to_numpy(dtype=float)
        f, th, l, r, s = _grow(X, rng, max_depth)
        return pd.DataFrame({"tree": [t], "feat": [f], "thr": [th], "left": [l], "right": [r], "size": [s]})

    built = sample.groupBy("tree").applyInPandas(
        build, "tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<long>")
    rows = sorted(built.collect(), key=lambda r: r["tree"])  # bounded: trees × nodes
    trees = [(r["feat"], r["thr"], r["left"], r["right"], r["size"]) for r in rows]
    model = IsolationForestModel(trees, psi, feats, 0.0)
    if contamination != "auto":
        scored = model.transform(train)
        q = fitted_quantiles(scored, ["anomaly_score"], [1.0 - float(contamination)])["anomaly_score"][0]
        model.threshold = q
    return model


# ------------------------------------------------------------ robust covariance

def scatter(df: DataFrame, feats: Sequence[str], center: dict, group: str | None = None) -> dict:
    """Σ (x−c)(x−c)ᵀ per group (key ``None`` without one) as d×d arrays.

    Rows are centred before anything is multiplied; every task adds its rows up
    and emits one matrix per group, and those are summed element by element."""
    d = len(feats)
    g = F.lit(0).cast("string") if group is None else F.col(group).cast("string")
    rows = df.select(g.alias("g"), F.array(*[F.col(c).cast("double") for c in feats]).alias("x"))
    middle = {None if k is None else str(k): np.asarray(v, float) for k, v in center.items()}

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby("g"):
                x = np.stack(part["x"].to_numpy()) - middle[None if group is None else key]
                sums[key] = sums.get(key, 0) + x.T @ x
        for key, m in sums.items():
            yield pd.DataFrame({"g": [key], "m": [m.ravel()]})

    parts = rows.mapInPandas(run, "g string, m array<double>")
    total = parts.select("g", F.posexplode("m").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in total.collect():  # d² numbers per group
        out.setdefault(None if group is None else r["g"], np.zeros((d, d)))[divmod(r["i"], d)] = r["v"]
    return out


def _moments(df: DataFrame, feats: Sequence[str]):
    """Mean and population covariance, centred in a second pass."""
    row = df.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}")
                                            for i, c in enumerate(feats)]).first()
    mu = np.array([row[f"m{i}"] for i in range(len(feats))], float)
    got = scatter(df, feats, {None: mu})
    return mu, got[None] / row["n"] if got else np.zeros((len(feats), len(feats)))


def mahalanobis_sq(mu: np.ndarray, prec: np.ndarray, feats: Sequence[str]):
    """Column expression (x−μ)ᵀ P (x−μ) with the fitted d×d literals."""
    d = len(feats)
    cen = [F.col(c) - F.lit(float(mu[i])) for i, c in enumerate(feats)]
    expr = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            if prec[i, j] != 0:
                expr = expr + F.lit(float(prec[i, j])) * cen[i] * cen[j]
    return expr


def elliptic_envelope(train: DataFrame, features: Sequence[str], contamination: float = 0.1,
                      max_steps: int = 10):
    """Concentration steps — fit mean/covariance on the kept rows, keep
    the h = ⌊(n+d+1)/2⌋ rows closest in Mahalanobis distance (exact
    quantile cut), repeat until the kept set is stable.  Threshold at the
    1 − contamination quantile of the training distances.  Returns
    (mu, precision, threshold)."""
    feats = list(features)
    x = train.select(*[F.col(c).cast("double").alias(c) for c in feats]).dropna()
    n, d = x.count(), len(feats)
    h_frac = min(1.0, ((n + d + 1) // 2) / n)
    kept = x
    mu, S = _moments(kept, feats)
    prev = None
    for _ in range(max_steps):
        prec = np.linalg.pinv(S)
        dist = x.withColumn("_d2", mahalanobis_sq(mu, prec, feats))
        cut = fitted_quantiles(dist, ["_d2"], [h_frac])["_d2"][0]
        kept = dist.where(F.col("_d2") <= F.lit(cut)).drop("_d2")
        mu2, S2 = _moments(kept, feats)
        det = np.linalg.det(S2)
        if prev is not None and det >= prev - 1e-12 * abs(prev):
            mu, S = mu2, S2
            break
        mu, S, prev = mu2, S2, det
    prec = np.linalg.pinv(S)
    d2 = x.withColumn("_d2", mahalanobis_sq(mu, prec, feats))
    thr = fitted_quantiles(d2, ["_d2"], [1.0 - contamination])["_d2"][0]
    return mu, prec, thr


def score_elliptic(df: DataFrame, features: Sequence[str], mu, prec, thr) -> DataFrame:
    d2 = mahalanobis_sq(mu, prec, features)
    return df.withColumn("anomaly_score", d2 - F.lit(thr)).withColumn(
        "is_anomaly", (F.col("anomaly_score") > 0).cast("int"))


# ------------------------------------------------------------ kernel novelty

def fourier_features(df: DataFrame, features: Sequence[str], n_components: int = 100,
                     gamma: float | None = None, seed: int = 42, out: str = "rff") -> tuple[DataFrame, dict]:
    """Random Fourier features z = √(2/D)·cos(Wx + b) approximating the RBF
    kernel exp(−γ|x−y|²); γ = 'scale' = 1/(d·var(X)) when not given.  The
    seeded W, b are literals in one projection (no UDF)."""
    feats = list(features)
    if gamma is None:
        long = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in feats])).alias("v"))
        var = long.agg(F.var_pop("v")).first()[0] or 1.0
        gamma = 1.0 / (len(feats) * var)
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, len(feats)))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)
    comps = []
    for k in range(n_components):
        lin = F.lit(float(b[k]))
        for i, c in enumerate(feats):
            lin = lin + F.lit(float(W[k, i])) * F.col(c).cast("double")
        comps.append(F.lit(scale) * F.cos(lin))
    return df.withColumn(out, F.array(*comps)), {"gamma": gamma, "W": W, "b": b}


def kernel_novelty(train: DataFrame, features: Sequence[str], nu: float = 0.1, n_components: int = 100,
                   seed: int = 42):
    """M25 (re-aimed one-class boundary): score = |φ(x) − mean φ| in the
    random-feature space; threshold at the 1 − nu training quantile."""
    z, params = fourier_features(train, features, n_components, None, seed)
    mean = np.array(z.select([F.avg(F.col("rff")[k]) for k in range(n_components)]).first(), dtype=float)
    params["mean"] = mean
    scored = _novelty_score(z, mean)
    params["threshold"] = fitted_quantiles(scored, ["anomaly_raw"], [1.0 - nu])["anomaly_raw"][0]
    return params


def _novelty_score(z: DataFrame, mean: np.ndarray) -> DataFrame:
    m = F.array(*[F.lit(float(v)) for v in mean])
    d2 = F.aggregate(F.zip_with("rff", m, lambda a, c: (a - c) * (a - c)), F.lit(0.0), lambda s, v: s + v)
    return z.withColumn("anomaly_raw", F.sqrt(d2))


def score_novelty(df: DataFrame, features: Sequence[str], params: dict, seed: int = 42) -> DataFrame:
    z, _ = fourier_features(df, features, len(params["b"]), params["gamma"], seed)
    s = _novelty_score(z, params["mean"])
    return (s.withColumn("anomaly_score", F.col("anomaly_raw") - F.lit(params["threshold"]))
            .withColumn("is_anomaly", (F.col("anomaly_score") > 0).cast("int")).drop("rff", "anomaly_raw"))
