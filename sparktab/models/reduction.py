"""Dimensionality reduction.

The d×d second-moment matrix is one aggregation on the executors (Gram,
A14); the eigen-decomposition of that small matrix runs on the driver and
the projection is a column expression — so rows never leave the executors
and d is the only size the driver sees (refused above MAX_DIM)."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.anomaly import _moments

MAX_DIM = 2000


class LinearProjection:
    def __init__(self, features, mean, components, explained_variance, explained_variance_ratio):
        self.features = list(features)
        self.mean = np.asarray(mean)
        self.components = np.asarray(components)  # k × d
        self.explained_variance = np.asarray(explained_variance)
        self.explained_variance_ratio = np.asarray(explained_variance_ratio)

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        cen = [F.col(c).cast("double") - F.lit(float(self.mean[i])) for i, c in enumerate(self.features)]
        outs = []
        for k, comp in enumerate(self.components):
            e = F.lit(0.0)
            for i, w in enumerate(comp):
                e = e + F.lit(float(w)) * cen[i]
            outs.append(e.alias(f"{prefix}{k + 1}"))
        return df.select("*", *outs)

    def inverse_transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """x̂ = z·V + mean, one expression per original column."""
        outs = []
        for i, c in enumerate(self.features):
            e = F.lit(float(self.mean[i]))
            for k in range(len(self.components)):
                e = e + F.col(f"{prefix}{k + 1}") * F.lit(float(self.components[k, i]))
            outs.append(e.alias(f"{c}_hat"))
        return df.select("*", *outs)

    def variance_table(self, spark) -> DataFrame:
        """Per component ratio and cumulative ratio."""
        cum = np.cumsum(self.explained_variance_ratio)
        rows = [(k + 1, float(v), float(r), float(c)) for k, (v, r, c) in
                enumerate(zip(self.explained_variance, self.explained_variance_ratio, cum))]
        return spark.createDataFrame(rows, "component int, explained_variance double, ratio double, cumulative double")


def _flip(V: np.ndarray) -> np.ndarray:
    """Deterministic signs: the largest-|w| entry of each component > 0."""
    idx = np.argmax(np.abs(V), axis=1)
    signs = np.sign(V[np.arange(V.shape[0]), idx])
    signs[signs == 0] = 1
    return V * signs[:, None]


def pca(df: DataFrame, features: Sequence[str], n_components: int = 2) -> LinearProjection:
    """Centred PCA; explained variance uses the sample (n−1) scale."""
    feats = list(features)
    if len(feats) > MAX_DIM:
        raise ValueError(f"{len(feats)} features exceed MAX_DIM={MAX_DIM}")
    x = df.select(*[F.col(c).cast("double").alias(c) for c in feats]).dropna()
    n = x.count()
    mu, S = _moments(x, feats)          # population covariance
    C = S * n / max(n - 1, 1)
    w, V = np.linalg.eigh(C)
    order = np.argsort(w)[::-1]
    w, V = w[order], V[:, order].T
    k = min(n_components, len(feats))
    return LinearProjection(feats, mu, _flip(V[:k]), w[:k], w[:k] / w.sum() if w.sum() > 0 else w[:k])


def truncated_svd(df: DataFrame, features: Sequence[str], n_components: int = 2) -> LinearProjection:
    """SVD of the uncentred matrix via XᵀX; explained variance =
    variance of each projected column / total variance of the columns."""
    feats = list(features)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in feats]).dropna()
    mu, S = _moments(x, feats)
    G = S + np.outer(mu, mu)            # XᵀX / n
    w, V = np.linalg.eigh(G)
    order = np.argsort(w)[::-1]
    V = _flip(V[:, order].T[:min(n_components, len(feats))])
    proj_var = np.array([v @ S @ v for v in V])
    total = np.trace(S)
    return LinearProjection(feats, np.zeros(len(feats)), V, proj_var, proj_var / total if total > 0 else proj_var)


def components_for_variance(table: DataFrame, threshold: float) -> DataFrame:
    """Smallest number of components whose cumulative ratio reaches the
    threshold, clamped to [1, n]."""
    n = F.max("component")
    hit = F.min(F.when(F.col("cumulative") >= threshold, F.col("component")))
    return table.agg(F.least(F.greatest(F.coalesce(hit, n), F.lit(1)), n).alias("n_components"))


def top_loadings(proj: LinearProjection, spark, per_component: int = 10, components: int = 5) -> DataFrame:
    """Largest |loading| features of the first components."""
    rows = [(k + 1, f, float(w)) for k, comp in enumerate(proj.components[:components])
            for f, w in zip(proj.features, comp)]
    df = spark.createDataFrame(rows, "component int, feature string, loading double")
    from pyspark.sql import Window
    w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_component)
