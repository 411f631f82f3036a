"""Exact tree attribution against the enumeration of all coalitions."""
from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from sparktab.models import boosting as B
from sparktab.models.attribution import (
    PathEnsemble, PathTree, attribution_ranking, boosted_paths, matrix, mllib_paths, tree_attributions)

NAMES = ["a", "b", "c", "d", "e"]


def value(tree: PathTree, x: np.ndarray, known: set, node: int = 0) -> np.ndarray:
    """The tree's expectation for one row when only some features are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    if f in known:
        left = tree.goes_left(node, x[f:f + 1])[0]
        return value(tree, x, known, tree.left[node] if left else tree.right[node])
    p, q = tree.shares(node)
    return p * value(tree, x, known, tree.left[node]) + q * value(tree, x, known, tree.right[node])


def brute(paths: PathEnsemble, x: np.ndarray) -> np.ndarray:
    d = paths.n_features
    out = np.zeros((d, len(paths.base)))
    for t in paths.trees:
        for j in range(d):
            others = [f for f in range(d) if f != j]
            for size in range(d):
                w = factorial(size) * factorial(d - size - 1) / factorial(d)
                for s in combinations(others, size):
                    out[j] += w * (value(t, x, {*s, j}) - value(t, x, set(s)))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (400, 5)).astype(float)
    y = 2 * x[:, 0] - x[:, 1] * (x[:, 2] > 4) + x[:, 3] * x[:, 4] / 3
    label = np.digitize(y, np.quantile(y, [0.4, 0.7])).astype(float)
    rows = [(i, *map(float, x[i]), float(y[i]), float(label[i]), float(label[i] > 0)) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y double, label double, two double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def outputs_of(fitted, df, kind):
    rows = sorted(fitted.transform(df).collect(), key=lambda r: r["id"])
    if kind == "margin":
        return np.array([[r["rawPrediction"][1]] for r in rows])
    return np.array([list(r["probability"]) if kind == "shares" else [r["prediction"]] for r in rows])


@pytest.mark.parametrize("kind,of,options", [
    ("shares", DecisionTreeClassifier, {"maxDepth": 4}),
    ("shares", RandomForestClassifier, {"numTrees": 3, "maxDepth": 4, "seed": 1}),
    ("value", RandomForestRegressor, {"labelCol": "y", "numTrees": 3, "maxDepth": 5, "seed": 1}),
    ("value", GBTRegressor, {"labelCol": "y", "maxIter": 3, "maxDepth": 3}),
    ("margin", GBTClassifier, {"labelCol": "two", "maxIter": 3, "maxDepth": 3})])
def test_saved_trees_equal_all_coalitions(spark, frame, kind, of, options):
    fitted = of(**options).fit(frame)
    paths = mllib_paths(fitted, 5)
    x = matrix(frame.orderBy("id").limit(6).toPandas()[NAMES].apply(list, axis=1), 5)
    phi = paths.attributions(x)
    for i in range(len(x)):
        assert phi[i] == pytest.approx(brute(paths, x[i]), abs=1e-9)
    got = tree_attributions(frame, paths, "features", "id").groupBy("id", "output").agg(F.sum("attribution").alias("s"))
    want = outputs_of(fitted, frame, kind)
    for r in got.collect():
        assert r["s"] == pytest.approx(want[r["id"], r["output"]] - paths.expectation()[r["output"]], abs=1e-9)


def test_boosted_trees_with_missing_values(spark, frame):
    rows = frame.select("id", F.array(*[F.when((F.col("id") + i) % 7 != 0, F.col(c)) for i, c in enumerate(NAMES)]).alias("x"),
                        F.col("label").alias("y"))
    model = B.fit(rows, "softmax", 5, B.Params(n_estimators=2, max_depth=4), classes=3)
    paths = boosted_paths(model, rows)
    assert paths.trees[0].cover[0] == 400
    x = matrix(rows.orderBy("id").toPandas()["x"], 5)
    assert np.isnan(x).any()
    phi = paths.attributions(x)
    assert phi.sum(1) == pytest.approx(model.margins(x) - paths.expectation(), abs=1e-9)
    assert paths.expectation() == pytest.approx(model.margins(x).mean(0), abs=1e-9)
    for i in range(0, 400, 90):
        assert phi[i] == pytest.approx(brute(paths, x[i]), abs=1e-9)


def test_categories_unseen_sides_and_repeated_features():
    """A feature asked twice on a path, a categorical split, a side where no background row went."""
    t = PathTree(np.array([0, 1, 0, -1, -1, -1, -1]), np.array([3.0, 0, 6, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]),
                 np.array([2, 4, 6, -1, -1, -1, -1]), np.zeros(7, bool), np.array([[0.0], [0], [0], [1], [-2], [5], [9]]),
                 np.array([10.0, 10, 0, 4, 6, 0, 0]), {1: [0.0, 2.0]})
    paths = PathEnsemble([t], np.zeros(1), 2)
    for row in ([1, 2], [1, 1], [5, 0], [8, 1], [np.nan, 2]):
        x = np.array([row], float)
        assert paths.attributions(x)[0] == pytest.approx(brute(paths, x[0]), abs=1e-12)


def test_columns_nulls_and_empty_tables(spark, frame):
    fitted = RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=3, seed=1).fit(frame)
    paths = mllib_paths(fitted, 5)
    odd = frame.select("id", *NAMES, F.lit(1).alias("attribution")).limit(3).withColumn("a", F.lit(None).cast("double"))
    out = tree_attributions(odd.unionByName(odd), paths, NAMES, "id")
    assert out.count() == 2 * 3 * 5 and out.where("attribution is null").isEmpty()
    assert attribution_ranking(out, 2).count() == 2
    assert tree_attributions(odd.where("false"), paths, NAMES, "id").isEmpty()
    with pytest.raises(ValueError):
        tree_attributions(odd, paths, NAMES[:2], "id")


@pytest.mark.parametrize("kept", [1 << 22, 0])
def test_rows_between_the_same_cuts_are_walked_once(monkeypatch, kept):
    from sparktab.models import attribution as AT
    monkeypatch.setattr(AT, "KEPT", kept)
    r = np.random.default_rng(2)

    def tree(missing_left):
        return PathTree(np.array([0, 1, -1, 0, -1, -1, -1]), np.array([0.5, 0.2, 0, 0.8, 0, 0, 0]), np.array([1, 2, -1, 4, -1, -1, -1]),
                        np.array([3, 6, -1, 5, -1, -1, -1]), np.full(7, missing_left), r.normal(size=(7, 2)), np.array([9.0, 4, 1, 5, 2, 3, 3]))
    paths = PathEnsemble([tree(True), tree(False)], np.zeros(2), 2)
    x = r.random((20_000, 2))
    x[r.random(x.shape) < 0.1] = np.nan
    x[:3] = [[0.5, 0.2], [0.8, 0.2], [np.inf, -np.inf]]
    want, walked = paths.attributions(x), []
    walk = PathTree.add_attributions
    monkeypatch.setattr(PathTree, "add_attributions", lambda self, x, out, node=0, *a: (
        walked.append(len(x)) if node == 0 else None, walk(self, x, out, node, *a))[1])
    by_cell = paths.by_cell()
    got = np.concatenate([by_cell(x[s:s + 5000]) for s in range(0, len(x), 5000)])
    assert np.allclose(got, want, atol=1e-12) and got.shape == want.shape
    assert sum(walked) <= (4 if not kept else 1) * 2 * 4 * 3  # batches x trees x cells
    assert by_cell(x[:0]).shape == (0, 2, 2)


def test_trees_with_categories_are_walked_for_every_row():
    t = PathTree(np.array([0, -1, -1]), np.zeros(3), np.array([1, -1, -1]), np.array([2, -1, -1]), np.zeros(3, bool),
                 np.array([[0.0], [1.0], [2.0]]), np.array([4.0, 1, 3]), {0: [0.0, 2.0]})
    paths = PathEnsemble([t], np.zeros(1), 1)
    x = np.array([[0.0], [1.0], [2.0]])
    assert np.array_equal(paths.by_cell()(x), paths.attributions(x))
