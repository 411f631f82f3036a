import numpy as np
import pytest

from sparktab.llm.code_search import SegmentIndex, top_k
from tests.conftest import SF_CHECK

SCHEMA = "vec_id long, embedding array<float>, label string"


@pytest.mark.parametrize(("n", "q", "m", "k"), [(300, 40, 4, 5), (3000, 50, 4, 11), (50, 10, 2, 60), (2000, 30, 1, 11), (500, 20, 5, 7)])
def test_index_finds_the_nearest_codes(n, q, m, k, monkeypatch):
    monkeypatch.setattr("sparktab.llm.code_search.PAIRS", 500)
    r = np.random.default_rng(1)
    codes = r.integers(0, 1 << 16, (n, m)).astype(np.uint16)
    codes[:n // 3] = codes[0]
    codes[n // 3:n // 2] ^= (1 << r.integers(0, 16, (n // 2 - n // 3, m))).astype(np.uint16)
    queries = codes[r.integers(0, n, q)].copy()
    queries[::2, 0] ^= 5
    ids = r.permutation(n).astype(np.int64)
    whose, rows, dist = SegmentIndex(codes).nearest(queries, k, ids)
    apart = np.bitwise_count(queries[:, None] ^ codes[None]).sum(2)
    for i in range(q):
        want = np.lexsort((ids, apart[i]))[:k]
        assert sorted(zip(dist[whose == i], ids[rows[whose == i]], strict=True)) == [(apart[i][x], ids[x]) for x in want]


def brute(rows, queries, k):
    out = []
    sign = {(i, tuple(x is not None and x == x and x > 0 for x in v)) for i, v in rows if i is not None and v is not None}
    width = max(len(c) for _, c in sign)
    sign = {(i, c + (False,) * (width - len(c))) for i, c in sign}
    for qid, q in sorted({(i, c) for i, c in sign if i in queries}):
        near = sorted((sum(a != b for a, b in zip(q, c, strict=True)), i) for i, c in sign if i != qid)[:k]
        out += [(qid, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 18, 100])
def test_embeddings_match_brute_force(spark, block):
    df = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    got = sorted(tuple(x) for x in top_k(df, df.where("vec_id % 100 = 0"), id_col="vec_id", vector_col="embedding", k=10,
                                         block=block).collect())
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    assert got == brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)


def test_edges(spark):
    nan = float("nan")
    rows = [(i, [1.0, -1.0, float(i % 3 - 1)], "a") for i in range(12)] + \
        [(100, [1.0, None, nan], None), (100, [1.0, None, nan], None), (100, [-1.0], "b"), (None, [1.0], "c"), (7, None, "d"),
         (200, [], "e"), (300, [1.0, -1.0, 1.0], "f")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as code", "3 as rank")
    got = sorted(tuple(x) for x in top_k(df, df.where("vec_id % 100 = 0"), id_col="vec_id", vector_col="embedding", k=3).collect())
    assert got == brute([(i, v) for i, v, _ in rows], {0, 100, 200, 300}, 3)
    empty = df.limit(0)
    assert top_k(empty, empty, id_col="vec_id", vector_col="embedding").count() == 0
