import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparktab.llm import suffix_dedup as sd
from tests.conftest import SF_SMALL

from .helpers import edge_frame, empty_frame, read_differently, stored


def brute(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.blake2b(x[i:i + length], digest_size=12).digest()
                   for x in raws for i in range(len(x) - length + 1))
    out = []
    for x in raws:
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if seen[hashlib.blake2b(x[i:i + length], digest_size=12).digest()] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:len(x)] > 0
        kept = np.frombuffer(x, np.uint8)[~mask].tobytes()
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((len(x), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_shard_and_merged_orders_are_sorted():
    r = random.Random(1)
    for _ in range(40):
        raw = "".join(r.choice("ab") for _ in range(200)).encode()
        data, length = np.frombuffer(raw, np.uint8), r.choice([20, 40, 64])
        cuts = sorted(r.sample(range(1, 200), 2))
        shards = [int(a) + sd.shard_order(data[a:b], np.arange(b - a), length)
                  for a, b in zip([0, *cuts], [*cuts, 200], strict=True)]
        rank, order, common = sd.interleave(data, np.concatenate(shards), length)
        strings = [raw[i:i + length] for i in order]
        assert strings == sorted(strings)
        for a, b, c in zip(strings, strings[1:], common[1:], strict=False):
            same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert c <= max(same, 8) and (c == length) == (same == length)
        whole = [i for i in order if i <= 200 - length]
        assert [rank[i] == rank[j] for i, j in zip(whole, whole[1:], strict=False)] == \
            [raw[i:i + length] == raw[j:j + length] for i, j in zip(whole, whole[1:], strict=False)]


def test_repeated_starts_match_counts(monkeypatch):
    r = random.Random(2)
    for _ in range(60):
        length = r.choice([20, 40, 64])
        base = "".join(r.choice("ab") for _ in range(90))
        texts = [(base[r.randrange(40):] + "".join(r.choice("ab") for _ in range(40)))[:length + r.randint(0, 30)].encode()
                 for _ in range(r.randint(1, 12))]
        widths = [len(t) - length + 1 for t in texts]
        monkeypatch.setattr(sd, "SHARD", r.choice([64, 100_000]))
        seen = Counter(t[i:i + length] for t, w in zip(texts, widths, strict=True) for i in range(w))
        got = sd.repeated_starts(texts, widths, length)
        assert [g.tolist() for g in got] == [[seen[t[i:i + length]] > 1 for i in range(w)]
                                             for t, w in zip(texts, widths, strict=True)]


def test_runs_cover_every_start_and_long_texts_in_parts(monkeypatch):
    r = random.Random(3)
    raw = "".join(r.choice("abcdefgh ") for _ in range(5000)).encode()
    whole = list(sd.anchored_runs(raw, 400))
    monkeypatch.setattr(sd, "PART", 700)
    parts = list(sd.anchored_runs(raw, 400))
    for runs in (whole, parts):
        assert [s for _, lo, hi in runs for s in range(lo, hi + 1)] == list(range(len(raw) - 399))
    anchor = lambda runs: {s: a for a, lo, hi in runs for s in range(lo, hi + 1)}
    assert anchor(whole) == anchor(parts)


def fixture(docs):
    r = random.Random(1)
    texts = [x.text for x in docs.collect()]
    for i in range(40):
        a = r.choice(texts)
        if a and len(a) > 900:
            p = r.randrange(len(a) - 10)
            texts += [a[:p] + r.choice(["", "X", "zz"]) + a[p + 1:], f"head {i} {a[100:900]} tail"]
    texts += ["a" * 1500, "ab" * 700, "x" * 399, "x" * 400, None, "", "é" * 300, "q" + "a" * 450]
    passage = "".join(r.choice("abcdef ghij") for _ in range(470))
    noise = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    return texts + [noise(r.randint(30, 300)) + passage + noise(200) for _ in range(40)]


@pytest.mark.parametrize("crowd", [1000, 8])
def test_documents_match_brute_force(spark, tmp_path, crowd, monkeypatch):
    texts = fixture(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    df = stored(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), tmp_path)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sd.remove_repeats(df, crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_edges(spark, tmp_path):
    df = stored(spark, edge_frame(spark), tmp_path)
    rows = df.collect()
    got = sd.remove_repeats(df, with_text=True).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    want = [(r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows]), strict=True)]
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got), key=key) == sorted(want, key=key)
    assert all(len(x.kept) == x.n_bytes - x.n_removed for x in got)
    assert sd.remove_repeats(stored(spark, empty_frame(spark), tmp_path / "e")).count() == 0
    with pytest.raises(ValueError, match="length"):
        sd.remove_repeats(df, length=100)


def test_other_splits_at_every_reading(spark, tmp_path, monkeypatch):
    """A lost or added executor changes how files are dealt into splits; the result stays."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs.repartition(12).write.parquet(str(tmp_path / "parts"))
    docs = spark.read.parquet(str(tmp_path / "parts"))
    want = sorted(tuple(r) for r in sd.remove_repeats(docs).collect())
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    read_differently(spark, monkeypatch, sd)
    try:
        assert sorted(tuple(r) for r in sd.remove_repeats(docs).collect()) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_planted_passages(spark):
    """Of 399 bytes nothing goes; of 400 and more the passage goes from every document, and nothing else."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    prose = lambda n: (" ".join(word() for _ in range(n)))
    rows, want = [], {}
    for i, n in enumerate((399, 400, 401, 1200)):
        passage = (prose(300))[:n - 2]
        for j in range(3):
            doc = 10 * i + j
            rows.append((doc, f"{prose(40)}{'#%'[j % 2]}{doc}\x01{passage}\x02{j}{prose(40)}"))
            want[doc] = n if n >= 400 else 0
    rows.append((99, prose(500)))
    want[99] = 0
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: g.n_removed for g in got} == want
    plain = brute([x for _, x in rows])
    assert {g.doc_id: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got} == \
        {i: p for (i, _), p in zip(rows, plain, strict=True)}


def test_crowded_cores_make_no_row_per_start(spark, monkeypatch):
    """One passage in many different documents: the rows grow with its runs, not with their starts."""
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    passage = noise(900)
    near = [passage[:450] + x + passage[450:] for x in "ABCDEFGH"]
    texts = [noise(r.randint(200, 400)) + r.choice([passage, *near]) + noise(300) for _ in range(90)]
    tables = {}
    plain = sd.written

    def counted(df, name):
        out = plain(df, name)
        tables.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(sd, "written", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sd.remove_repeats(df, crowd=8).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert len(tables["halves"]) > 1
    assert max(max(n) for n in tables.values()) <= max(2 * tables["contexts"][0], tables["runs"][0])


@pytest.mark.parametrize("ranks", [2, 3])
def test_merging_refines_only_what_starts_need(monkeypatch, ranks):
    """Few starts of long contexts: tails are refined no deeper than the starts ask for."""
    r = random.Random(8)
    length, core = 400, "".join(r.choice("abcd") for _ in range(380)).encode()
    tails = [bytes(r.choice(b"ab") for _ in range(40)) for _ in range(100)]
    contexts = [bytes(r.choice(b"ab") for _ in range(3)) + core + r.choice(tails) for _ in range(200)]
    widths, sorted_rows, sort = [len(c) - length + 1 for c in contexts], [], np.argsort
    monkeypatch.setattr(sd, "SHARD", 10_000)
    if ranks == 2:  # as in very large buckets
        monkeypatch.setattr(sd, "_steps", lambda n, length, steps=sd._steps: steps(1 << 30, length))
    monkeypatch.setattr(np, "argsort", lambda a, **k: sorted_rows.append(len(a)) or sort(a, **k))
    got = sd.repeated_starts(contexts, widths, length)
    monkeypatch.undo()
    seen = Counter(c[i:i + length] for c, w in zip(contexts, widths, strict=True) for i in range(w))
    assert [g.tolist() for g in got] == [[seen[c[i:i + length]] > 1 for i in range(w)] for c, w in zip(contexts, widths, strict=True)]
    assert any(g.any() for g in got) and not all(g.all() for g in got)
    assert sum(sorted_rows) < 10 * sum(map(len, contexts))
