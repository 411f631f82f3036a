import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.functions.stats import chi2_sf, ks_pvalue
from sparktab.operators import drift as D
from sparktab.operators import metrics as M
from sparktab.operators.running import running_sums


def test_perfect_classification(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "y int, p int")
    r = M.classification_metrics(df, "y", "p", binary=False).first()
    assert r["accuracy"] == 1.0 and r["f1"] == 1.0 and r["mcc"] == pytest.approx(1.0)


def test_binary_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    r = M.classification_metrics(df, "y", "p", binary=True, positive="1").first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0


def test_auc_midranks(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    # pairs: (0.9 vs 0.9 tie 0.5) + (0.9 > 0.1) + (0.5 < 0.9) + (0.5 > 0.1) = 2.5 / 4
    assert M.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(0.625)
    area = M.roc_area(M.roc_curve(df, "y", "s")).first()["auc"]
    assert area == pytest.approx(0.625)


def test_regression_rmse(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["rmse"] == pytest.approx(math.sqrt(r["mse"]))
    assert r["mse"] == pytest.approx(5 / 3)


def test_anomaly_ratio(spark):
    df = spark.createDataFrame([(x,) for x in [0, 0, 1, 0, 1]], "p int")
    r = M.anomaly_metrics(df, "p").first()
    assert r["n_anomalies"] == 2 and r["anomaly_ratio"] == pytest.approx(0.4)


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(c, 0.5, size=(15, 2)) for c in ((0, 0), (5, 0), (2.5, 4))])
    lab = np.repeat([0, 1, 2], 15)
    df = spark.createDataFrame([(i, X[i].tolist(), int(lab[i])) for i in range(len(X))], "id int, x array<double>, c int")
    got = M.silhouette_sq(df, "x", "c", 2).first()["silhouette"]
    D2 = ((X[:, None] - X[None]) ** 2).sum(-1)
    s = []
    for i in range(len(X)):
        a = D2[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        b = min(D2[i, lab == k].mean() for k in set(lab) if k != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s))


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_running_sums_bucket_invariant(spark, buckets):
    rows = [("a" if i % 2 else "b", float(i % 17), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, n int").groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = {(r["g"], r["v"]): r["cum_n"] for r in running_sums(df, ["g"], "v", ["n"], buckets=buckets).collect()}
    for (g, v), c in got.items():
        assert c == sum(1 for x in rows if x[0] == g and x[1] <= v)


def test_chi2_and_ks_tails(spark):
    df = spark.createDataFrame([(1.1115, 2), (0.1158, 1), (10.0, 5), (0.0, 3)], "x double, k int")
    got = [r[0] for r in df.select(chi2_sf("x", "k")).collect()]
    assert got[0] == pytest.approx(math.exp(-1.1115 / 2), abs=1e-9)
    assert got[1] == pytest.approx(math.erfc(math.sqrt(0.1158 / 2)), abs=1e-6)
    assert got[2] == pytest.approx(0.07523524614651217, abs=1e-6)
    assert got[3] == 1.0
    p = spark.createDataFrame([(0.0,)], "d double").select(ks_pvalue("d", F.lit(100), F.lit(100))).first()[0]
    assert p == 1.0


def test_psi_identical_is_zero_and_shift_detected(spark):
    a = spark.createDataFrame([(float(i % 50), "x" if i % 3 else "y") for i in range(500)], "v double, c string")
    rep = D.detect_drift(a, a, {"v": "numerical", "c": "categorical"}, ["v", "c"]).collect()
    assert all(r["psi"] == 0.0 and not r["drifted"] for r in rep)
    b = spark.createDataFrame([(float(i % 50) + 30, "y") for i in range(500)], "v double, c string")
    rep2 = {r["column"]: r for r in D.detect_drift(a, b, {"v": "numerical", "c": "categorical"}, ["v", "c"]).collect()}
    assert rep2["v"]["drifted"] and rep2["v"]["ks_statistic"] == pytest.approx(0.6)
    assert rep2["c"]["drift_label"] == "Significant drift"


def test_drift_few_values_error_row(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    r = D.drift_numeric(a, a, ["v"]).first()
    assert r["error"].startswith("Insufficient") and r["psi"] is None


def test_chi2_null_when_current_category_unseen(spark):
    a = spark.createDataFrame([("x",)] * 10 + [("y",)] * 10, "c string")
    b = spark.createDataFrame([("x",)] * 10 + [("z",)] * 10, "c string")
    r = D.drift_categorical(a, b, ["c"]).first()
    assert r["chi2_statistic"] is None and r["psi"] > 0.25


def test_improvement_rule():
    from sparktab.models.retrain import improved
    assert improved(None, 0.1, "regression")
    assert improved(0.5, 0.6, "regression") and not improved(0.6, 0.6, "regression")
    assert improved(0.10, 0.13, "anomaly_detection") and improved(0.2, 0.1, "anomaly_detection")
    assert not improved(0.10, 0.20, "anomaly_detection")


def test_histogram_quantile_interpolates(spark):
    from sparktab.streaming import monitor as MO
    rows = [("w", 0, 0.1, 2), ("w", 1, 0.5, 6), ("w", 2, 1.0, 10), ("w", 3, float("inf"), 10)]
    h = spark.createDataFrame(rows, "window_start string, bucket int, le double, cum_count long")
    # rank 5 falls in bucket (0.1, 0.5]: 0.1 + 0.4 * (5 - 2) / (6 - 2)
    assert MO.histogram_quantile(h, 0.5).first()["p50"] == pytest.approx(0.4)
    rows2 = [("w", 0, 0.1, 0), ("w", 1, float("inf"), 4)]
    h2 = spark.createDataFrame(rows2, "window_start string, bucket int, le double, cum_count long")
    assert MO.histogram_quantile(h2, 0.99).first()["p99"] == pytest.approx(0.1)


def test_running_sums_descending(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1)], "v double, n int")
    got = {r["v"]: r["cum_n"] for r in running_sums(df, [], "v", ["n"], descending=True, buckets=2).collect()}
    assert got == {3.0: 1, 2.0: 2, 1.0: 3}
