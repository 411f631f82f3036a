import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import neighbors as N


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(parts)


def brute(q, r, k, exclude_self):
    out = {}
    for i, v in enumerate(q):
        d = np.sqrt(((r - v) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(r)), d)) if not (exclude_self and i == j)][:k]
        out[i] = [(int(j), n + 1) for n, j in enumerate(order)]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r.rid, r["rank"]))
    return {q: sorted(v, key=lambda x: x[1]) for q, v in out.items()}


@pytest.mark.parametrize("dim,leaf", [(2, 40), (6, 25)])
def test_deep_trees_find_all_neighbours(spark, monkeypatch, dim, leaf):
    monkeypatch.setattr(N, "FAN", 4)
    r = np.random.default_rng(dim)
    x = np.concatenate([r.normal(c, s, (150, dim)) for c, s in ((0, 1), (8, 0.2), (-5, 3))])
    df = frame(spark, x)
    got = found(N.knn_join(df, df, 5, exclude_self=True, leaf_rows=leaf))
    assert got == brute(x, x, 5, True)


def test_equal_rows_and_ties(spark, monkeypatch):
    """Most rows are one point: they end in a leaf of their own, and ties go to the smaller id."""
    monkeypatch.setattr(N, "FAN", 4)
    r = np.random.default_rng(0)
    x = np.concatenate([np.zeros((200, 2)), r.integers(0, 6, (120, 2)).astype(float)])
    df = frame(spark, x)
    assert found(N.knn_join(df.where("id % 10 = 0"), df, 7, leaf_rows=20)) == {
        i: v for i, v in brute(x, x, 7, False).items() if i % 10 == 0}


def test_more_neighbours_than_rows(spark):
    x = np.arange(10.0).reshape(5, 2)
    df = frame(spark, x)
    assert found(N.knn_join(df, df, 9, leaf_rows=2)) == brute(x, x, 9, False)
    assert N.knn_join(df, df.limit(0), 3).count() == 0 and N.knn_join(df.limit(0), df, 3).count() == 0


def test_work_grows_slower_than_the_table(spark):
    """Distances per query: pivots of the levels and rows of the visited leaves."""
    r = np.random.default_rng(5)
    centres = r.uniform(-100, 100, (40, 3))

    def work(n):
        x = centres[r.integers(0, 40, n)] + r.normal(0, 1, (n, 3))
        table = frame(spark, x, 8)
        q = N._prep(table.where(F.col("id") < 200), "id", "features", "qid", "qv")
        tree = N.MetricTree(N._prep(table, "id", "features", "rid", "rv"), 512, 4096)
        home, further = N.knn_visits(q, tree, 5, False)
        near = N.knn_join(table.where(F.col("id") < 200), table, 5, leaf_rows=512)
        bounds = near.groupBy("qid").agg(F.max("dist").alias("bound"))
        sizes = tree.rows.groupBy("node").count()
        met = home.select("qid", "node").unionByName(further(bounds).select("qid", "node")).join(sizes, "node")
        return met.agg(F.sum("count")).first()[0] / 200 + 2 * N.FAN * len(tree.levels)

    small, large = work(4000), work(40_000)
    assert large < 0.1 * 40_000 and large / small < 4


def neighbour_rows(df):
    return sorted((r.qid, r["rank"], r.rid, round(r.dist, 9)) for r in df.collect())


def test_many_dimensions_write_no_row_per_query_and_leaf(spark, monkeypatch):
    """No pivot rules a leaf out, so queries would go to all of about 30 leaves."""
    monkeypatch.setattr(N, "STREAM_ROWS", 100)
    x = np.random.default_rng(6).normal(0, 1, (600, 24))
    df, rows, write = frame(spark, x), {}, N.written

    def counted(table, name):
        out = write(table, name)
        nodes = F.sum(F.size("nodes")) if "nodes" in out.columns else F.count("*")
        rows[name] = max(rows.get(name, 0), out.agg(nodes).first()[0] or 0)
        return out

    monkeypatch.setattr(N, "written", counted)
    met = []
    monkeypatch.setattr(N, "_met", lambda q, *a, real=N._met, **kw: met.append(q.count()) or real(q, *a, **kw))
    got = found(N.knn_join(df, df, 4, exclude_self=True, leaf_rows=100))
    assert got == brute(x, x, 4, True)
    assert max(met) <= N.FEW_LEAVES * 600 and rows["knn-best"] == 4 * 600 and rows["query-blocks"] < 20


def test_streamed_blocks_equal_leaf_visits(spark, monkeypatch):
    """Ties, equal rows, repeated and missing ids, and a far group."""
    monkeypatch.setattr(N, "FAN", 16)
    monkeypatch.setattr(N, "STREAM_ROWS", 40)
    r = np.random.default_rng(7)
    x = np.concatenate([np.zeros((90, 3)), r.integers(0, 4, (120, 3)).astype(float), 1e6 + r.normal(0, 1e-3, (40, 3))])
    odd = spark.createDataFrame([(3, [0.0, 1.0, 2.0]), (4, [0.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0])], "id long, features array<double>")
    df = frame(spark, x).unionByName(odd)
    tree = N.knn_tree(df, 6, "id", "features", leaf_rows=60)
    results = []
    for few in (1e9, 0):
        monkeypatch.setattr(N, "FEW_LEAVES", few)
        results.append(neighbour_rows(N.knn_join(df, df, 6, exclude_self=True, tree=tree)))
    assert tree.levels and results[0] == results[1] and results[0]


def test_bounds_that_rounding_touches():
    """Rows far from the origin and close together: products of matrices cannot order them."""
    r = np.random.default_rng(8)
    x = 1e7 + r.normal(0, 1e-2, (300, 5))
    ids, k = np.arange(300), 7
    dist, best, bound = np.full((300, k), np.inf), np.full((300, k), np.iinfo(np.int64).max), np.full(300, np.inf)
    for at in range(0, 300, 60):
        N._put_nearest(ids, x, bound, dist, best, ids[at:at + 60], x[at:at + 60], True)
    assert {i: [(int(j), n + 1) for n, j in enumerate(b)] for i, b in enumerate(best)} == brute(x, x, k, True)
