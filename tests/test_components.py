import random

import pytest

from sparktab.operators import components as C


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long").repartition(3)


def found(df):
    return {r.node: r.component for r in C.connected_components(df, "src", "dst").collect()}


@pytest.mark.parametrize("part", [500_000, 40])
def test_long_chain_and_random_graph(spark, monkeypatch, part):
    monkeypatch.setattr(C, "PART_EDGES", part)
    r = random.Random(2)
    order = r.sample(range(1000), 1000)
    edges = list(zip(order, order[1:], strict=False))
    edges += [(2000 + r.randrange(300), 2000 + r.randrange(300)) for _ in range(150)]
    edges += [(5000, 5000), (None, 1), (7, None), (-3, 6000), (-3, 6000)]
    assert found(frame(spark, edges)) == plain(edges)


def test_no_edges(spark):
    assert found(frame(spark, [(1, 2)]).limit(0)) == {}
