"""What keeps the fits, folds and neighbours within their limits on large tables."""
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktab.models import boosting as B
from sparktab.models import extra as EX
from sparktab.models import train as T
from sparktab.operators import impute_knn as I
from sparktab.operators import neighbors as N
from sparktab.operators import split as S
from sparktab.operators.running import running_sums
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hashed(key):
    return -1 if key is None else int(hashlib.md5(f"42:{key}".encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def keyed(spark):
    keys = [f"a{i // 2}" if i < 40 else None if i < 44 else f"b{i}" for i in range(401)]
    return spark.createDataFrame([(k, i % 3, float(i)) for i, k in enumerate(keys)], "k string, g int, v double"), keys


def test_split_cuts_the_hash_order_at_exact_sizes(spark, keyed):
    df, keys = keyed
    ordered = sorted(keys, key=lambda k: (hashed(k), k or ""))
    want = [(k, "test" if i < 81 else "val" if i < 121 else "train") for i, k in enumerate(ordered)]
    out = S.assign_split(df.repartition(5), "k")
    text = lambda rows: sorted((k or "", s) for k, s in rows)
    assert text((r["k"], r["split"]) for r in out.collect()) == text(want)
    assert out.columns == ["k", "g", "v", "split"]


def test_ranks_within_groups(spark, keyed):
    df, keys = keyed
    out = S.hash_rank(df, "k", ["g"]).collect()
    for g in range(3):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: r["_rank"])
        assert [r["_rank"] for r in mine] == list(range(len(mine))) and {r["_n"] for r in mine} == {len(mine)}
        assert [hashed(r["k"]) for r in mine] == sorted(hashed(r["k"]) for r in mine)


def test_fits_read_a_written_split(spark):
    from sparktab.plans import q_models, q_neighbors, q_ops
    for df in (q_models._lineitem(spark, SF_SMALL), q_ops._splits(spark, SF_SMALL), q_neighbors._emb_split(spark, SF_SMALL)):
        assert "Exchange" not in plan(df)
    assert set(q_models._lineitem(spark, SF_SMALL).columns) == {"k", *q_models.LI_FEATS, "l_returnflag", "split"}


def test_running_sums_have_a_task_for_every_part(spark):
    df = spark.range(100).select("id", F.lit(1).alias("one"))
    out = running_sums(df, [], "id", ["one"], n_rows=100, rows_per_part=10)
    assert "hashpartitioning(_part" in plan(out) and ", 10)" in plan(out)
    assert sorted(r["cum_one"] for r in out.collect()) == list(range(1, 101))


def test_fold_scores_are_those_of_plain_fits(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    df = spark.createDataFrame([(i, float(v), float(2 * v + e), i % 3) for i, (v, e) in enumerate(zip(x, rng.normal(size=60), strict=True))],
                               "id long, x double, y double, fold int")
    lr = LinearRegression(labelCol="y")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), lr])
    ev = RegressionEvaluator(metricName="r2", labelCol="y")
    maps = [{lr.regParam: 0.0}, {lr.regParam: 5.0}]
    got = T.fold_scores(pipe, maps, df, ev, 3)
    want = [[ev.evaluate(pipe.fit(df.where(f"fold <> {i}"), m).transform(df.where(f"fold = {i}"))) for m in maps] for i in range(3)]
    assert got == pytest.approx(np.array(want))


def test_learning_curve_caches_nothing(spark, monkeypatch):
    df = spark.range(90).select("id", (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 + F.col("id") * 2.0).alias("y"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    seen = []
    real = EX.M.regression_metrics
    monkeypatch.setattr(EX.M, "regression_metrics", lambda d, *a: seen.append(d) or real(d, *a))
    assert EX.learning_curve(df, "id", ["x"], "y", n_sizes=2, folds=3).count() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    ids = sorted(range(90), key=lambda i: (hashed(i), i))
    kept = [i for at, i in enumerate(ids) if at % 3 != 0]
    assert sorted(r["id"] for r in seen[0].collect()) == sorted(kept[:6]) and seen[1].count() == 30


def test_boosting_unpacks_slices_of_batches():
    bins = np.arange(12, dtype=np.uint8).reshape(4, 3)
    margin = np.arange(8.0).reshape(4, 2)
    batch = pa.RecordBatch.from_pydict({"row": [0, 1, 2, 3], "y": [0.0, 1.0, 2.0, 3.0]})
    packed = B._packed(batch, pa.array([b.tobytes() for b in bins], pa.binary()), margin).slice(1, 2)
    got = B._unpacked(packed, 3)
    assert (got[0] == bins[1:3]).all() and (got[1] == margin[1:3]).all()


def test_shapley_needs_no_window_and_repeated_ids_share_a_mean(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = spark.createDataFrame([(i, float(i), float(i * i % 5), 3.0 * i - 2.0 * (i * i % 5)) for i in range(12)],
                               "id long, a double, b double, y double")
    m = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LinearRegression(labelCol="y")]).fit(df)
    out = EX.mc_shapley(m, df.unionAll(df), ["a", "b"], "id", {"a": 1.0, "b": 2.0}, 3)
    assert "Window" not in plan(out)
    got = {(r["id"], r["feature"]): r["attribution"] for r in out.collect()}
    assert got == {(i, f): pytest.approx(v, abs=1e-6) for i in range(12)
                   for f, v in (("a", 3.0 * (i - 1)), ("b", -2.0 * (i * i % 5 - 2)))}


def test_single_linkage_counts_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "neighbour_counts", None)
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0]), (4, [float("nan")]), (5, [None])], "id long, x array<double>")
    got = {r["id"]: r["cluster"] for r in N.single_linkage(df, 1.0, "id", "x").collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: -1}  # as before: no place in the grid, no row


def test_imputing_rows_meet_few_of_many_equal_donors(spark, monkeypatch):
    rows = [(i, None if i % 5 == 0 else float(i), float(i % 3), float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    sizes = []
    real = I.DonorIndex
    monkeypatch.setattr(I, "DonorIndex", lambda donors, d: sizes.append(donors.count()) or real(donors, d))
    got = {r["id"]: r["a"] for r in I.knn_impute(df, ["a", "b", "c"], "id", 4).collect()}
    for i, a, b, c in rows:
        near = sorted((abs(b - y) ** 2 + abs(c - z) ** 2, j, x) for j, x, y, z in rows if x is not None)[:4]
        assert got[i] == pytest.approx(np.mean([x for *_, x in near]) if a is None else a)
    assert sizes == [24]  # six places, four donors each


def test_donors_count_once_for_every_repeat_of_a_row(spark):
    df = spark.createDataFrame([(1, None, 0.0), (1, None, 0.0), (2, None, 0.0), (3, 1.0, 0.0), (4, 4.0, 0.0), (5, 10.0, 3.0)],
                               "id long, a double, b double")
    got = {r["id"]: r["a"] for r in I.knn_impute(df, ["a", "b"], "id", 3).collect()}
    assert got == {1: 2.0, 2: 5.0, 3: 1.0, 4: 4.0, 5: 10.0}  # 1, 1, 4 and 1, 4, 10, as the SQL twin has it
