import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.models import anomaly as AN
from sparktab.models import reduction as RD
from sparktab.operators import neighbors as N
from sparktab.operators.impute_knn import knn_impute


def _blobs(spark, n_per=40, seed=0):
    rng = np.random.default_rng(seed)
    centers = [(0, 0), (5, 0), (2.5, 4)]
    X = np.vstack([rng.normal(c, 0.4, size=(n_per, 2)) for c in centers])
    return X, spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, x array<double>")


def test_knn_matches_numpy_small_blocks(spark):
    X, df = _blobs(spark)
    got = N.knn_join(df, df, 3, "id", "id", "x", "x", exclude_self=True, block_rows=25).collect()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    want = {(i, int(j)) for i in range(len(X)) for j in np.argsort(D[i], kind="stable")[:3]}
    assert {(r["qid"], r["rid"]) for r in got} == want


def test_dbscan_blobs_and_noise(spark):
    X, df = _blobs(spark)
    far = spark.createDataFrame([(999, [50.0, 50.0])], "id long, x array<double>")
    lab = N.dbscan(df.unionByName(far), eps=1.0, min_samples=5, id_col="id", vec="x", block_rows=30)
    got = {r["id"]: r["cluster"] for r in lab.collect()}
    assert got[999] == -1
    assert len({got[i] for i in range(len(X))} - {-1}) == 3
    assert got[0] == 0  # numbered by smallest core id


def _density(x, eps, least):
    """(cluster, core) of every row by all pairs."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, label, n = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], todo = n, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core], default=-1)
    return list(zip(label.tolist(), core.tolist(), strict=True))


@pytest.mark.parametrize("dim,least", [(1, 4), (2, 1), (3, 5)])
def test_small_cells_give_the_clusters_of_all_pairs(spark, dim, least):
    """Blobs, scattered rows, repeated points, and points exactly eps apart."""
    r = np.random.default_rng(dim + least)
    x = np.concatenate([r.normal(c, s, (60, dim)) for c, s in ((0, 0.4), (4, 0.8), (-6, 0.2))]
                       + [r.uniform(-9, 9, (40 * dim, dim)), np.repeat(r.normal(0, 3, (5, dim)), 4, 0),
                          np.array([[30.0 + i] + [0.0] * (dim - 1) for i in range(8) for _ in range(2)])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    odd = spark.createDataFrame([(1001, [float("nan")] * dim), (1002, [None] * dim)], df.schema)
    for crowd in (0, N.CROWD):
        got = {g.id: (g.cluster, g.core) for g in N.dbscan(df, 1.0, least, "id", "x", 50, crowd).collect()}
        assert [got[i] for i in range(len(x))] == _density(x, 1.0, least)
    key = lambda g: tuple((v is not None, v) for v in g)
    small, wide = (sorted((tuple(g) for g in N.dbscan(df.unionByName(odd).unionByName(df.where("id % 7 = 0")), 1.0, max(least, 2),
                                                      "id", "x", 50, crowd).collect()), key=key) for crowd in (0, N.CROWD))
    assert small == wide


def test_crowded_cells_meet_no_pairs_of_points(spark, monkeypatch):
    """Four times the points in the same place: as many pairs of boxes, and no distances between points."""
    sizes = []
    plain = N._met

    def counted(q, r, keys, *a, **k):
        sizes.append((q.groupBy(*keys).count().withColumnRenamed("count", "n").join(
            r.groupBy(*keys).count(), keys).selectExpr("sum(n * count)").first()[0]) or 0)
        return plain(q, r, keys, *a, **k)
    monkeypatch.setattr(N, "_met", counted)

    def pairs(n):
        del sizes[:]
        r = np.random.default_rng(1)
        x = np.round(r.uniform(0, 2, (n, 2)) * 8) / 8
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        assert {(g.cluster, g.core) for g in N.dbscan(df, 0.5, 5, "id", "x", crowd=100).collect()} == {(0, True)}
        return sum(sizes)
    assert pairs(16_000) <= 1.1 * pairs(4000)


def test_lof_flags_isolated_point(spark):
    X, df = _blobs(spark)
    far = spark.createDataFrame([(999, [20.0, 20.0])], "id long, x array<double>")
    allp = df.unionByName(far)
    lof = {r["id"]: r["lof"] for r in N.local_outlier_factor(allp, 10, "id", "x", query=allp).collect()}
    assert lof[999] > 1.5 and np.median(list(lof.values())) < 1.5


def test_isolation_forest_scores_outlier_highest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(v[0]), float(v[1])) for i, v in enumerate(rng.normal(size=(300, 2)))] + [(1000, 8.0, 8.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    m = AN.isolation_forest(df, ["a", "b"], "id", 50)
    top = m.transform(df).orderBy(F.desc("anomaly_score")).first()
    assert top["id"] == 1000 and top["is_anomaly"] == 1


def test_pca_variance_ratios(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(200, 3)) @ np.diag([3.0, 1.0, 0.1])
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double")
    p = RD.pca(df, ["a", "b", "c"], 3)
    ev = np.linalg.eigvalsh(np.cov(X.T))[::-1]
    assert p.explained_variance_ratio == pytest.approx(ev / ev.sum(), rel=1e-6)
    z = p.transform(df)
    assert abs(z.agg(F.corr("pc1", "pc2")).first()[0]) < 1e-6


def test_mc_shapley_exact_for_linear_model(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from sparktab.models.extra import mc_shapley
    rng = np.random.default_rng(3)
    X = rng.normal(size=(60, 3))
    y = X @ np.array([2.0, -1.0, 0.5]) + 3
    df = spark.createDataFrame([(i, *map(float, X[i]), float(y[i])) for i in range(60)], "id long, a double, b double, c double, y double")
    m = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"),
                         LinearRegression(labelCol="y")]).fit(df)
    base = {"a": 0.1, "b": -0.2, "c": 0.3}
    attr = {(r["id"], r["feature"]): r["attribution"] for r in mc_shapley(m, df, ["a", "b", "c"], "id", base, 3).collect()}
    coef = m.stages[-1].coefficients.toArray()
    for i in (0, 7, 59):
        for j, f in enumerate("abc"):
            assert attr[(i, f)] == pytest.approx(coef[j] * (X[i, j] - base[f]), abs=1e-6)


def test_preprocessor_save_load_round_trip(spark, tmp_path):
    from sparktab.operators import prep as PR
    df = spark.createDataFrame([(1.0, "a", "x"), (None, "b", "y"), (3.0, None, "x")], "n double, c string, o string")
    rec = {"n": PR.ColumnRecipe("numerical", "median", "standard"),
           "c": PR.ColumnRecipe("categorical", "most_frequent", "onehot"),
           "o": PR.ColumnRecipe("categorical", "most_frequent", "ordinal")}
    pre = PR.Preprocessor(rec).fit(df)
    PR.save_preprocessor(pre, spark, str(tmp_path / "pre"))
    back = PR.load_preprocessor(spark, str(tmp_path / "pre"))
    a = sorted(map(tuple, pre.transform(df).collect()))
    b = sorted(map(tuple, back.transform(df).collect()))
    assert a == b and back.output_names() == pre.output_names()


def test_elbow_picks_largest_second_difference(spark):
    from sparktab.models.extra import elbow
    scan = spark.createDataFrame([(2, 100.0, 0.3), (3, 40.0, 0.5), (4, 30.0, 0.4), (5, 25.0, 0.35)],
                                 "k int, inertia double, silhouette double")
    r = elbow(scan).first()
    assert r["elbow_k"] == 3 and r["best_silhouette_k"] == 3


def test_single_linkage_isolated_point_own_cluster(spark):
    X, df = _blobs(spark)
    far = spark.createDataFrame([(999, [50.0, 50.0])], "id long, x array<double>")
    lab = {r["id"]: r["cluster"] for r in N.single_linkage(df.unionByName(far), 1.5, "id", "x").collect()}
    assert lab[999] != -1 and sum(1 for v in lab.values() if v == lab[999]) == 1
    assert len(set(lab.values())) >= 4


def test_knn_impute_falls_back_to_mean(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, 20.0), (3, None, None), (4, 5.0, None)],
                               "id long, a double, b double")
    out = {r["id"]: (r["a"], r["b"]) for r in knn_impute(df, ["a", "b"], "id", 2).collect()}
    assert out[3] == (3.0, 15.0)            # no shared coordinate: donor means
    assert out[4][1] == pytest.approx(15.0)  # two nearest donors on a: ids 2 and 1
    assert out[1] == (1.0, 10.0)
