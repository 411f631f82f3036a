import numpy as np
import pytest

from sparktab.operators import hierarchy as H


def brute(x, k, linkage):
    """Merge the two nearest clusters, looked for among all pairs, until k are left."""
    groups = [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def height(a, b):
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        return {"complete": np.max, "average": np.mean, "single": np.min}[linkage](d[np.ix_(a, b)])
    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: height(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    label = np.zeros(len(x), int)
    for n, g in enumerate(sorted(groups, key=min)):
        label[g] = n
    return label.tolist()


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(parts)


def labels(df):
    return [r.cluster for r in sorted(df.collect(), key=lambda r: r.id)]


@pytest.mark.parametrize("linkage", H.LINKAGES)
def test_matches_all_pairs(spark, linkage):
    r = np.random.default_rng(7)
    for n, k, dim in ((120, 5, 2),) if linkage == "single" else ((120, 5, 2), (60, 3, 6)):
        x = np.concatenate([r.normal(c, 1.0, (n // 4, dim)) for c in (0, 4, 9, 20)])
        assert labels(H.agglomerate(frame(spark, x), k, linkage)) == brute(x, k, linkage)


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
def test_tree_heights_match(linkage):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (80, 3))
    merges = H.merge_tree(x, np.ones(80), linkage)
    assert len(merges) == 79 and [m[2] for m in merges] == sorted(m[2] for m in merges)
    for k in (2, 10, 40):
        _, want = np.unique(brute(x, k, linkage), return_inverse=True)
        got = H.cut(merges, 80, k)
        pairs = {(a, b) for a, b in zip(got.tolist(), want.tolist(), strict=True)}
        assert len(pairs) == k == len(set(got.tolist()))


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
def test_more_rows_than_leaves(spark, linkage):
    """Leaves hold several rows; clear groups are still found, whatever the number of tasks."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.3, (400, 2)) for c in ((0, 0), (10, 0), (0, 10), (30, 30))])
    want = np.repeat(range(4), 400).tolist()
    for parts in (1, 11):
        assert labels(H.agglomerate(frame(spark, x, parts), 4, linkage, leaves=50)) == want


def test_leaves_keep_rows_and_sums():
    r = np.random.default_rng(2)
    x = r.normal(0, 5, (3000, 3))
    leaves = H.Leaves(3, 100)
    for s in range(0, 3000, 100):
        part = x[s:s + 100]
        leaves.take(np.ones(len(part)), part, (part * part).sum(1))
    assert len(leaves.n) <= 100 and leaves.n.sum() == 3000 and leaves.radius > 0
    assert leaves.sum.sum(0) == pytest.approx(x.sum(0)) and leaves.sq.sum() == pytest.approx((x * x).sum())


def test_long_chains_with_single_linkage(spark):
    """Two chains of 5,000 points each, closer in the middle of space than ward would allow."""
    a = np.stack([np.arange(5000) * 1.0, np.zeros(5000)], 1)
    x = np.concatenate([a, a + [0.5, 3.0]])
    assert labels(H.agglomerate(frame(spark, x, 4), 2, "single")) == [0] * 5000 + [1] * 5000


@pytest.mark.parametrize("last", [500_000, 20])
def test_minimum_forest(spark, monkeypatch, last):
    """All edges in one task, and Borůvka rounds down to twenty."""
    monkeypatch.setattr(H, "LAST_EDGES", last)
    r = np.random.default_rng(4)
    edges = {(a, b): float(r.integers(1, 30)) for a, b in ((int(a), int(b)) for a, b in r.integers(0, 60, (200, 2))) if a < b}
    got = {(r.a, r.b): r.w for r in H.minimum_forest(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()],
                                                                          "a long, b long, w double")).collect()}
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    want = {}
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want[a, b] = w
    assert got == want


def test_ties_repeats_and_few_rows(spark):
    x = np.array([[0.0, 0.0]] * 5 + [[9.0, 9.0]] * 3)
    for linkage in H.LINKAGES:
        assert labels(H.agglomerate(frame(spark, x), 5, linkage)) == [0] * 5 + [1] * 3
        assert labels(H.agglomerate(frame(spark, x), 1, linkage)) == [0] * 8
        assert H.agglomerate(frame(spark, x).limit(0), 3, linkage).count() == 0
    with pytest.raises(ValueError):
        H.agglomerate(frame(spark, x), 2, "median")
