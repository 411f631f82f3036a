import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import impute_knn as I


def brute(x, k):
    d, out = x.shape[1], x.copy()
    for i in range(len(x)):
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        n = both.sum(1)
        far = np.where(n > 0, np.sqrt(d / np.maximum(n, 1) * np.where(both, (x - x[i]) ** 2, 0).sum(1)), np.inf)
        for f in np.flatnonzero(np.isnan(x[i])):
            ok = [j for j in np.lexsort((np.arange(len(x)), far)) if np.isfinite(far[j]) and not np.isnan(x[j, f])][:k]
            out[i, f] = x[ok, f].mean() if ok else np.nanmean(x[:, f])
    return out


def frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"c{j} double" for j in range(x.shape[1]))).repartition(3)


def table(df, d):
    return np.array([[r[f"c{j}"] for j in range(d)] for r in sorted(df.collect(), key=lambda r: r.id)], float)


def clustered(n, d, seed, holes=0.15):
    r = np.random.default_rng(seed)
    x = r.uniform(-50, 50, (12, d))[r.integers(0, 12, n)] + r.normal(0, 1, (n, d))
    x[r.random((n, d)) < holes] = np.nan
    return x


@pytest.mark.parametrize("fan,block", [(32, 128), (3, 8)])
def test_matches_all_pairs(spark, monkeypatch, fan, block):
    """One block a pattern, and small blocks under several levels."""
    monkeypatch.setattr(I, "FAN", fan)
    monkeypatch.setattr(I, "BLOCK", block)
    x = clustered(240, 4, 1)
    x[:5] = np.nan  # nothing to go by
    x[:, 3] = np.where(np.arange(240) % 60 == 7, x[:, 3], np.nan)  # fewer donors than k
    cols = [f"c{j}" for j in range(4)]
    assert table(I.knn_impute(frame(spark, x), cols, "id", 5), 4) == pytest.approx(brute(x, 5), nan_ok=True)


def test_a_column_without_any_donor(spark):
    x = clustered(30, 3, 2)
    x[:, 1] = np.nan
    out = [r.asDict() for r in I.knn_impute(frame(spark, x), ["c0", "c1", "c2"], "id", 3).collect()]
    assert all(r["c1"] is None and r["c0"] is not None for r in out)
    assert I.knn_impute(frame(spark, x).limit(0), ["c0", "c1", "c2"], "id", 3).count() == 0


def test_few_pairs_are_met_on_clustered_rows(spark):
    x = clustered(20_000, 3, 3, holes=0.0)
    x[::50, 1] = np.nan
    df = frame(spark, x)
    values = F.array(*[F.col(f"c{j}") for j in range(3)])
    index = I.DonorIndex(df.select(F.col("id").alias("rid"), values.alias("rv")), 3)
    q = df.where("c1 is null").select(F.col("id").alias("qid"), values.alias("qv"))
    seen = []
    leaves = index.leaves

    def watched(*a, **k):
        seen.append(leaves(*a, **k))
        return seen[-1]
    index.leaves = watched
    I.impute_candidates(q, index, 5)
    sizes = index.rows.groupBy("pattern", "up").count()
    home = q.count() * I.BLOCK
    met = home + seen[-1].join(sizes, ["pattern", "up"]).agg(F.sum("count")).first()[0]
    assert met < 0.1 * q.count() * 20_000
