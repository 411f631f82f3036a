import hashlib
import zlib

import pytest

from sparktab.llm import merkle as M
from sparktab.llm.queries import QUERIES
from tests.conftest import SF_SMALL

from .helpers import SCHEMA, edge_frame, empty_frame


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_path(nodes, at):
    """(what remains, [(siblings before, after) level by level]) of place ``at``."""
    path = []
    while len(nodes) > 1:
        a = at // 8 * 8
        path.append((nodes[a:at], nodes[at + 1:a + 8]))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return nodes[0], path


def plain(rows):
    """The contract's rows one leaf at a time, from (doc_id, text, lang, source, n_chars)."""
    langs = {}
    for i, x, lang, source, n in rows:
        langs.setdefault(lang, []).append((i, plain_leaf(i, source, lang, n, x), x, source, n))
    names = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    for k in names:
        langs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    subs = [plain_path([r[1] for r in langs[k]], 0)[0] for k in names]
    out = []
    for g, k in enumerate(names):
        for at, (i, leaf, x, source, n) in enumerate(langs[k]):
            sub, path = plain_path([r[1] for r in langs[k]], at)
            root, above = plain_path(subs, g)
            used = x
            if i is not None and x is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                used = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            fold = plain_leaf(i, source, k, n, used)
            for before, after in path + above:
                fold = sha("".join([*before, fold, *after]))
            proof = sha("".join("".join(b + a) for b, a in path + above))
            out.append((i, leaf, sub, root, proof, fold, fold == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def check(df):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]
    got = order([tuple(r) for r in M.verify_manifest(df).collect()])
    assert got == order(plain(rows))
    return got


def test_matches_brute_force(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = check(df)
    assert {r[6] for r in got} == {True, False}
    assert order([tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SF_SMALL).collect()]) == got


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [64], [65], [1, 1, 1], [73, 1, 8], [1] * 20 + [9] * 3])
def test_shapes(spark, sizes):
    """Lone leaves and languages, full and broken runs, more languages than a run holds."""
    rows = [(100 * g + i, f"Text {i}", f"l{g:02}" if g else None, "S", i) for g, n in enumerate(sizes) for i in range(n)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_crowded_nodes_are_stored_once_a_block(spark, monkeypatch):
    """Small blocks: the same result, and no copy of a node is passed by more runs than a block has."""
    rows = [(i, f"Text {i}", "x" if i % 5 else f"y{i % 3}", "S", i) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = check(df)
    monkeypatch.setattr(M, "BLOCK_LEVEL", 2)
    monkeypatch.setattr(M, "BLOCK_RUNS", 8)
    seen = {}
    climbed = M._climbed

    def watched(starts, nodes):
        seen.update(nodes=nodes.collect(), starts=starts.collect())
        return climbed(starts, nodes)
    monkeypatch.setattr(M, "_climbed", watched)
    assert order([tuple(r) for r in M.verify_manifest(df).collect()]) == want
    passed = {}
    for r in seen["starts"]:
        passed.setdefault((r.home, r.block), set()).add(r.run)
    assert max(map(len, passed.values())) == 8
    keys = [(n.grp, n.level, n.pos, n.home, n.block) for n in seen["nodes"]]
    assert len(keys) == len(set(keys)) and {k[3:] for k in keys if k[0] == -1} == set(passed)


def test_edges(spark):
    df = edge_frame(spark)
    check(df)
    clash = df
    for c in ("row", "leaf", "used", "one", "grp", "pos", "home", "run", "block", "n", "hash", "kids", "leaves", "proof",
              "level", "place", "folds", "root"):
        if c not in df.columns:
            clash = clash.selectExpr("*", f"'x' as {c}")
    assert M.verify_manifest(clash).count() == df.count()
    assert M.verify_manifest(empty_frame(spark)).count() == 0
    only_ascii = spark.createDataFrame([(i, "ÀÉ Straße İ ABC", "de", None, None) for i in range(30)], SCHEMA)
    check(only_ascii)


def test_row_limit_is_restored(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    M.verify_manifest(edge_frame(spark))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
