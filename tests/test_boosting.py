import numpy as np
import pytest
from pyspark.ml import PipelineModel

from sparktab.models import boosting as B
from sparktab.models import catalog as CAT
from sparktab.models import train as T


def plain_tree(x, g, h, p, depth=0):
    """(predicted weight of every row, gain if the node is a split above leaves) by trying every value as a cut."""
    def score(a, b):
        return (np.sign(a) * max(abs(a) - p.reg_alpha, 0)) ** 2 / (b + p.reg_lambda)
    best = (B.LEAST_GAIN, None)
    if depth < p.max_depth:
        for f in range(x.shape[1]):
            gone = np.isnan(x[:, f])
            for cut in np.unique(x[~gone, f])[:-1]:
                for missing_left in (True, False) if gone.any() else (True,):
                    left = np.where(gone, missing_left, x[:, f] <= cut)
                    gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                    gain = score(gl, hl) + score(gr, hr) - score(g.sum(), h.sum())
                    if min(hl, hr) >= p.min_child_weight and gain > best[0] + 1e-12:
                        best = (gain, left)
    w = -np.sign(g.sum()) * max(abs(g.sum()) - p.reg_alpha, 0) / (h.sum() + p.reg_lambda) * p.learning_rate
    if best[1] is None:
        return np.full(len(x), w), True
    out, leaf = np.empty(len(x)), True
    for side in (best[1], ~best[1]):
        out[side], alone = plain_tree(x[side], g[side], h[side], p, depth + 1)
        leaf &= alone
    if leaf and best[0] < p.gamma:
        return np.full(len(x), w), True
    return out, False


def plain_fit(x, y, objective, p, classes):
    base = {"squared": y.mean(), "logistic": np.log(y.mean() / (1 - y.mean())) if 0 < y.mean() < 1 else 0, "softmax": 0.0}[objective]
    m = np.full((len(y), classes if objective == "softmax" else 1), base)
    for _ in range(p.n_estimators):
        m = m + np.stack([plain_tree(x, *B.gradients(objective, y, m, k), p)[0] for k in range(m.shape[1])], 1)
    return m


def frame(spark, x, y):
    return spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)],
                                 "x array<double>, y double").repartition(3)


def data(seed, n=160, missing=0.1):
    r = np.random.default_rng(seed)
    x = r.integers(0, 12, (n, 3)).astype(float)
    x[r.random((n, 3)) < missing] = np.nan
    z = np.nan_to_num(x[:, 0]) - 2 * (np.nan_to_num(x[:, 1]) > 5) + r.normal(0, 1, n)
    return x, z


@pytest.mark.parametrize("objective,params", [
    ("squared", B.Params(n_estimators=3, max_depth=3, min_child_weight=4, reg_alpha=1.0, reg_lambda=0.5)),
    ("squared", B.Params(n_estimators=2, max_depth=4, gamma=30.0)),
    ("logistic", B.Params(n_estimators=12, max_depth=2, learning_rate=0.5, min_child_weight=0.5)),
    ("softmax", B.Params(n_estimators=2, max_depth=2, reg_lambda=2.0)),
])
def test_matches_trying_every_split(spark, objective, params):
    x, z = data(3)
    y = {"squared": z, "logistic": (z > 3).astype(float), "softmax": np.digitize(z, [2, 6]).astype(float)}[objective]
    model = B.fit(frame(spark, x, y), objective, 3, params, classes=3)
    assert model.margins(x) == pytest.approx(plain_fit(x, y, objective, params, 3), abs=1e-9)


def test_nodes_in_several_jobs(spark, monkeypatch):
    x, z = data(3)
    p, y = B.Params(n_estimators=2, max_depth=3), np.digitize(z, [2, 6]).astype(float)
    monkeypatch.setattr(B, "HISTOGRAMS", 9)  # three nodes a job
    monkeypatch.setattr(B, "SETTLED", 1)
    assert B.fit(frame(spark, x, y), "softmax", 3, p, classes=3).margins(x) == pytest.approx(
        plain_fit(x, y, "softmax", p, 3), abs=1e-9)


def test_every_parameter_changes_the_tree_as_its_formula_says():
    x, z = data(5, missing=0.0)
    g, h = -z, np.ones(len(z))
    for p in (B.Params(max_depth=1), B.Params(max_depth=1, reg_lambda=50.0), B.Params(max_depth=1, reg_alpha=40.0),
              B.Params(max_depth=1, min_child_weight=70), B.Params(max_depth=1, gamma=1e9)):
        cuts = np.unique(x[:, 0])
        bins = np.searchsorted(cuts[:-1], x[:, 0], "left")
        gain, at, _, gl, hl = B.best_split(np.bincount(bins, g, len(cuts)), np.bincount(bins, h, len(cuts)), (0.0, 0.0), p)
        w, _ = plain_tree(x[:, :1], g, h, p)
        assert gain > 0 and min(hl, len(z) - hl) >= p.min_child_weight
        if p.gamma:
            assert len(np.unique(w)) == 1
        else:
            left = x[:, 0] <= cuts[at]
            assert w[left] == pytest.approx(-B.shrunk(gl, p.reg_alpha) / (hl + p.reg_lambda) * p.learning_rate)


def test_row_samples_do_not_depend_on_parts():
    row = np.arange(20_000)
    a = B.sampled(row, 3, 0.3, 42)
    assert abs(a.mean() - 0.3) < 0.02 and (B.sampled(row[::-1], 3, 0.3, 42)[::-1] == a).all()
    assert (B.sampled(row, 4, 0.3, 42) != a).any() and B.sampled(row, 1, 1.0, 42).all()


def test_quantile_cuts_for_many_values(spark):
    r = np.random.default_rng(1)
    x = np.stack([r.normal(0, 1, 3000), r.integers(0, 5, 3000)], 1)
    cuts = B.feature_cuts(frame(spark, x, x[:, 0]), 2, most=50)
    assert 40 <= len(cuts[0]) <= 50 and cuts[1].tolist() == [0, 1, 2, 3]
    share = np.searchsorted(np.sort(x[:, 0]), cuts[0], "right") / 3000
    assert share == pytest.approx(np.arange(1, len(share) + 1) / 51, abs=0.02)


@pytest.mark.parametrize("task", ["regression", "binary_classification", "multiclass_classification"])
def test_pipeline_save_and_load(spark, tmp_path, task):
    x, z = data(9, missing=0.0)
    label = {"regression": z.tolist(), "binary_classification": ["ab"[int(v > 3)] for v in z],
             "multiclass_classification": ["abc"[int(np.digitize(v, [2, 6]))] for v in z]}[task]
    kind = "double" if task == "regression" else "string"
    df = spark.createDataFrame([(i, *map(float, r), t) for i, (r, t) in enumerate(zip(x, label, strict=True))],
                               f"id long, a double, b double, c double, target {kind}")
    res = T.train_model(df, df, "xgboost", task, ["a", "b", "c"], "target", "id", {"n_estimators": 8, "max_depth": 3})
    assert (res.metrics["r2"] if task == "regression" else res.metrics["accuracy"]) > 0.6
    assert [n for n, _ in T.feature_importances(res)][0] in ("a", "b")
    T.save_model(res, str(tmp_path / "m"))
    again, _ = T.load_model(spark, str(tmp_path / "m"))
    want, got = (sorted((r.id, r.prediction) for r in T.score(m, df, task, res.classes).collect()) for m in (res.model, again))
    assert got == want and isinstance(again, PipelineModel)


def test_unknown_parameters_raise():
    with pytest.raises(ValueError):
        CAT.make_estimator("xgboost", "regression", {"max_leaves": 4})
    with pytest.raises(ValueError):
        CAT.make_estimator("xgboost", "multiclass_classification")


def test_no_rows(spark):
    df = spark.createDataFrame([], "x array<double>, y double")
    with pytest.raises(ValueError):
        B.fit(df, "squared", 1)
