import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from sparktab.models import cell_trees as CT
from sparktab.models.catalog import make_estimator


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(3)
    a, b, c = r.integers(0, 20, 3000), r.integers(0, 9, 3000), r.integers(0, 5, 3000)
    y = (a * 3.0 + b * c + r.normal(0, 4, 3000)).round(3)
    k = ((a + b * 2 + r.integers(0, 12, 3000)) % 3)
    rows = spark.createDataFrame([(*map(float, v),) for v in zip(a, b, c, y, k, strict=True)], "a double, b double, c double, y double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).repartition(3).cache()


def unsampled(seed=1):
    return [RandomForestClassifier(numTrees=2, maxDepth=6, bootstrap=False, featureSubsetStrategy="all", minInstancesPerNode=3, seed=seed),
            RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=5, bootstrap=False, featureSubsetStrategy="all", minInstancesPerNode=2, seed=seed),
            GBTRegressor(labelCol="y", maxIter=8, maxDepth=3, stepSize=0.2, seed=seed)]


def trees_of(model):
    """Every tree's splits and values, as MLlib prints them."""
    return [t._java_obj.toDebugString().split("\n", 1)[1] for t in model.trees]


def spared(monkeypatch, est):
    """A fit by cells that may not fall back."""
    monkeypatch.setattr(type(est), "fit", lambda *a: pytest.fail("left to MLlib"))
    return CT.CellTrees(est, rows=0)


@pytest.mark.parametrize("i", range(3))
def test_without_draws_the_trees_are_mllibs(frame, monkeypatch, i):
    est = unsampled()[i]
    want = est.fit(frame)
    got = spared(monkeypatch, est).fit(frame)
    assert type(got) is type(want)

    def numbers(text):
        return [round(float(w.strip("()")), 6) for w in text.split() if w.strip("()").replace(".", "").replace("-", "").replace("E", "").isdigit()]
    for g, w in zip(trees_of(got), trees_of(want), strict=True):
        assert len(g.splitlines()) == len(w.splitlines()) and numbers(g) == numbers(w)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    both = [m.transform(frame).select("a", "b", "c", "prediction").distinct().orderBy("a", "b", "c").toPandas() for m in (got, want)]
    assert np.allclose(both[0].to_numpy(), both[1].to_numpy())


@pytest.mark.parametrize("model", ["random_forest", "gradient_boosting"])
def test_drawn_fits_are_as_good_as_mllibs(frame, monkeypatch, model):
    est = make_estimator(model, "regression", {"n_estimators": 30, "max_depth": 4}, label="y")
    assert isinstance(est, CT.CellTrees)
    plain = est.mllib.fit(frame)
    got = spared(monkeypatch, est.mllib).fit(frame)
    assert got.getNumTrees == 30
    err = [m.transform(frame).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] for m in (got, plain)]
    spread = frame.agg(F.var_pop("y")).first()[0]
    assert err[0] < 0.4 * spread and abs(err[0] - err[1]) < 0.1 * spread
    again = CT.CellTrees(est.mllib, rows=0).fit(frame)
    assert trees_of(again) == trees_of(got) and len(set(trees_of(got))) > 10


def test_a_classifying_forest_does_not_depend_on_the_layout(frame, monkeypatch, tmp_path):
    est = RandomForestClassifier(numTrees=10, maxDepth=6, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=5)
    plain = est.fit(frame)
    cells = spared(monkeypatch, est)
    got, other = cells.fit(frame), cells.fit(frame.repartition(7))
    assert trees_of(got) == trees_of(other) and len(set(trees_of(got))) == 10
    hit = [m.transform(frame).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] for m in (got, plain)]
    assert abs(hit[0] - hit[1]) < 0.05
    whole = Pipeline(stages=[cells]).fit(frame)
    whole.write().save(f"{tmp_path}/model")
    back = PipelineModel.load(f"{tmp_path}/model")
    want = got.transform(frame).select("a", "probability").collect()
    assert back.transform(frame).select("a", "probability").collect() == want


def test_few_rows_and_other_fits_are_left_to_mllib(frame):
    est = unsampled()[1]
    assert CT._fitted(frame, est, 3000) is None and CT._fitted(frame, est, 2999) is not None
    assert CT._fitted(frame, GBTRegressor(labelCol="y", lossType="absolute"), 0) is None
    assert CT._fitted(frame.withColumn("w", F.lit(1.0)), RandomForestRegressor(labelCol="y", weightCol="w"), 0) is None
    assert CT._fitted(frame.withColumn("y", F.when(F.col("a") > 3, F.col("y"))), est, 0) is None  # null labels
    assert len(trees_of(CT.CellTrees(est).fit(frame))) == 2


def test_cuts_are_middles_of_few_values_and_quantiles_of_many(spark):
    rows = spark.range(4000).select(F.array(F.col("id").cast("double"), (F.col("id") % 4).cast("double"), F.lit(2.0)).alias("x"))
    q = rows.agg(F.percentile_approx(F.col("x")[0], [0.25, 0.5, 0.75], 10_000)).first()[0]
    cuts = CT.feature_cuts(rows, 3, 4, [4000, 4, 1], [q, [0.0], [2.0]])
    assert [c.tolist() for c in cuts] == [q, [0.5, 1.5, 2.5], []]


def test_draws_follow_their_chances():
    rng = np.random.default_rng(1)
    for cdf, p in ((CT.draw_cdf(1.0, True), [np.exp(-1) / f for f in (1, 1, 2, 6, 24)]), (CT.draw_cdf(0.8, False), [0.2, 0.8])):
        n = CT.drawn(rng, 400_000, cdf, *CT.draw_table(cdf))
        share = np.bincount(n.astype(int)) / len(n)
        assert np.abs(share[:len(p)] - p).max() < 0.004


def test_importances_of_a_classifying_forest_of_many_rows(frame, monkeypatch):
    from sparktab.models import train as TR
    est = make_estimator("random_forest", "multiclass_classification", {"n_estimators": 20, "max_depth": 5})
    plain = est.mllib.fit(frame).featureImportances.toArray()
    fitted = Pipeline(stages=[spared(monkeypatch, est.mllib)]).fit(frame)
    got = TR.feature_importances(TR.TrainingResult("random_forest", "multiclass_classification", {}, {}, model=fitted, features=["a", "b", "c"]))
    assert [n for n, _ in got] == ["a", "b", "c"] or got == sorted(got, key=lambda t: -t[1])
    assert abs(sum(v for _, v in got) - 1) < 1e-9 and np.allclose([dict(got)[n] for n in "abc"], plain, atol=0.08)
