import hashlib
import random
import zlib

import pytest

from sparktab.llm import prefix_trie as P
from sparktab.llm.queries import QUERIES
from tests.conftest import SF_CHECK, SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    """Every node of the contract by its list of turns."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[:len(q)] == q and len(r) == len(q) + 1 for r in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if made[c] == p)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=lambda r: (r[1], r[0]))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, SF_SMALL)) == plain(rows)


@pytest.mark.parametrize("band", [2, 3, 8])
def test_random_tries(spark, monkeypatch, band):
    """Shared prefixes, gaps in the blocks, and depths over several bands of bands."""
    monkeypatch.setattr(P, "BAND", band)
    r = random.Random(band)
    stems = [[(r.choice("ua"), r.choice(["x", "yy", "zzz"])) for _ in range(30)] for _ in range(3)]
    rows = []
    for c in r.sample(range(0, 420), 60):
        stem = r.choice(stems)[:r.randint(1, 30)]
        rows += [(c, i, *t) for i, t in enumerate(stem + [("u", "own")] * r.randint(0, 2))]
    assert got(P.prefix_trie(frame(spark, rows))) == plain(rows)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    """Cut over many range parts; the same nodes."""
    from sparktab.operators import running
    rows = [(7, i, "u", f"t{i}") for i in range(300)] + [(c, i, "u", f"t{i}") for c in (8, 9, 300) for i in range(c % 7 + 1)]
    want = plain(rows)
    monkeypatch.setattr(P, "running_sums", lambda df, *a, **k: running.running_sums(df, *a, **k, rows_per_part=40))
    assert got(P.prefix_trie(frame(spark, rows))) == want


def test_copies_of_one_conversation(spark, monkeypatch):
    """A node at which very many conversations end is hashed over several strings."""
    monkeypatch.setattr(P, "ENDS_PER_PART", 25)
    rows = [(c, i, "u", f"same {i}") for c in range(0, 400) for i in range(3)] + [(1000, 0, "u", "other")]
    assert got(P.prefix_trie(frame(spark, rows))) == plain(rows)


def test_edges(spark):
    rows = [(None, 0, "u", "no conversation"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 2, "a", ""),
            (2, 0, "user", "x" * 500_000), (100, 0, "u", "tie b"), (100, 0, "u", "tie a"), (103, 0, "u", "tie a"), (105, 1, "a", "é" * 7),
            (-5, 0, "u", "negative"), (-105, 0, "u", "negative"), (250, 0, "u", "gone with its block"), (251, 0, "u", "gone too")]
    df = frame(spark, rows).repartition(3)
    assert got(P.prefix_trie(df)) == plain(rows)
    clash = df
    for c in ("conv", "row", "digest", "chars", "one", "pos", "depth", "node", "parent", "h", "base", "total", "up", "inside", "part"):
        clash = clash.selectExpr("*", f"'x' as {c}")
    assert got(P.prefix_trie(clash)) == plain(rows)
    assert P.prefix_trie(df.limit(0)).count() == 0
    assert P.prefix_trie(frame(spark, [(None, 1, "u", "t")])).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(short, 0, "u", "replaced by nothing"), (short, 1, "u", "this too")]
    out = got(P.prefix_trie(frame(spark, rows)))
    assert out == plain(rows) and len(out) == 1 and out[0][:6] == (short, 0, None, 1, 0, 1)


def test_whole_table_once_more(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, SF_CHECK)) == plain(rows)
