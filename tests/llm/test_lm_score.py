import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.llm import lm_score as L
from sparktab.llm.queries import QUERIES
from tests.conftest import SF_SMALL

from .helpers import CLASHES, edge_frame, empty_frame


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def is_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain_base(rows):
    """(held_out, n_tokens, n_known, N, base) of (doc_id, text) rows, one token at a time."""
    train = Counter(t for i, x in rows if not is_out(i) for t in plain_tokens(x))
    n, v = sum(train.values()), len(train)
    out = []
    for i, x in rows:
        toks = plain_tokens(x)
        out.append((i, is_out(i), len(toks), sum(train[t] > 0 for t in toks), n,
                    sum(math.log10((train[t] + 1) / (n + v + 1)) for t in toks)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:3], round(r[5], 6)))


def test_base_matches_plain_counts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = order(plain_base([(r.doc_id, r.text) for r in docs.collect()]))
    got = order([tuple(r)[:6] for r in QUERIES["op11_lm_scoring"](spark, SF_SMALL).collect()])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_missing_words_are_joined(spark):
    """The same rows however few words go to the tasks."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a, b = (order([tuple(r) for r in L.score_texts(docs, frequent=n, shortlist=50, tails=16, dim=4, rounds=2).collect()])
            for n in (1 << 17, 60))
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], rel=1e-9)


def test_beats_the_unigram_model_on_held_out_texts(spark):
    out = L.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = out.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s > r.b + 0.05 * r.n


def small_vocab():
    texts = [b"a b c a b c a b", b"b c a dd dd ee", b"a b zz"]
    tails, short = 3, 3
    c = Counter(w for t in texts for w in t.split())
    rows = sorted(((w, L.tail_of(w, tails), k) for w, k in c.items()), key=lambda r: (-r[2], r[0]))
    n, v = np.zeros(tails, np.int64), np.zeros(tails, np.int64)
    for _, t, k in rows[short:]:
        n[t] += k
        v[t] += 1
    symbol = np.array([1 + i if i < short else 1 + short + t for i, (_, t, _) in enumerate(rows)], np.int16)
    count = np.array([k for _, _, k in rows])
    return texts, L.Vocabulary({w: i for i, (w, _, _) in enumerate(rows)}, symbol, count, 1 + short, tails,
                               np.concatenate([[3], count[:short], n]), n + v + 1, int(count.sum()) + 3, len(c) + 1, 3)


def test_probabilities_are_normalised():
    """Over every known word, the end, and one share per tail for what was never met."""
    texts, v = small_vocab()
    r = np.random.default_rng(1)
    m = L.Model.start(v.shares, 5, 1).with_weights(r.normal(0, 1.5, L.Model.start(v.shares, 5, 1).flat().size))
    for before in ([0, 0, 0], [1, 2, 3], [5, 0, 1]):
        ctx = np.tile(np.array(before, np.int16), (v.size, 1))
        p = np.exp(m.log_probabilities(ctx, np.arange(v.size)))
        assert p.sum() == pytest.approx(1, abs=1e-5)
        q = sum(m.C[i].T @ m.R[s] for i, s in enumerate(before))
        e = [math.exp(float(q @ m.Q[w] + m.b[w])) for w in range(v.size)]
        assert p == pytest.approx(np.array(e) / sum(e), rel=1e-4)
        total = p[0] + sum(p[s] if s < v.first_tail else p[s] * (c + 1) / v.tail_total[s - v.first_tail]
                           for s, c in zip(v.symbol, v.count, strict=True))
        total += sum(p[v.first_tail + t] / v.tail_total[t] for t in range(v.tails))
        assert total == pytest.approx(1, abs=1e-5)


def test_extreme_weights_stay_finite():
    _, v = small_vocab()
    m = L.Model.start(v.shares, 4, 1)
    m = m.with_weights(m.flat() * 200 + 90)
    assert np.isfinite(m.log_probabilities(np.zeros((2, 3), np.int16), np.array([0, 3]))).all()


@pytest.mark.parametrize("spread", [0.5, 3.0, 12.0])
def test_scoring_takes_no_exponential_per_position(monkeypatch, spread):
    """The exact softmax of summed scores, from tables that grow with the symbols and not with the positions."""
    r = np.random.default_rng(4)
    m = L.Model.start(np.ones(40), 6, 1)
    m = m.with_weights(r.normal(0, spread, m.flat().size))
    ctx, own = r.integers(0, 40, (5000, 3)).astype(np.int16), r.integers(0, 40, 5000).astype(np.int16)
    q = sum(m.R.astype(float)[ctx[:, i]] @ m.C[i] for i in range(3))
    scores = q @ m.Q.T.astype(float) + m.b
    top = scores.max(1, keepdims=True)
    want = (scores - top)[np.arange(5000), own] - np.log(np.exp(scores - top).sum(1))
    taken, exp = [], np.exp
    monkeypatch.setattr(L.np, "exp", lambda x, *a, **k: taken.append(x.size) or exp(x, *a, **k))
    got = np.concatenate([m.log_probabilities(ctx[a:a + 100], own[a:a + 100]) for a in range(0, 5000, 100)])
    assert got == pytest.approx(want, rel=1e-4, abs=1e-3 * spread ** 2)
    assert spread > 1 or sum(taken) == 3 * 40 * 40


def test_texts_are_encoded_together():
    """Every text has the numbers it has alone, with empty texts and long and missing words between."""
    _, v = small_vocab()
    texts = [b"a b c zz new new", b"", b"ee " * 40 + b"x" * 50, b"  ", b"new A DD other", b""]
    got = L.encode(texts, L.Coder(v))
    ends, missed = [0, *got.ends.tolist()], [0, *got.missing[0].tolist()]
    for i, text in enumerate(texts):
        words = text.lower().split()
        at = [v.words.get(w, -1) for w in words]
        want = [v.symbol[k] if k >= 0 else v.first_tail + L.tail_of(w, v.tails) for w, k in zip(words, at, strict=True)]
        assert got.symbols[ends[i]:ends[i + 1]].tolist() == [*want, 0]
        assert got.words[i] == len(words) and got.known[i] == 1 + sum(v.count[k] > 0 for k in at if k >= 0)
        assert got.base[i] == pytest.approx(math.log10(v.ends + 1) + sum(v.log_count[k] for k in at if k >= 0))
        tails = [(k, s - v.first_tail) for k, s in zip(at, want, strict=True) if s >= v.first_tail]
        assert got.tail[i] == pytest.approx(sum((v.log_count[k] if k >= 0 else 0) - v.log_total[t] for k, t in tails))
        part = slice(missed[i], missed[i + 1])
        assert dict(zip(got.missing[1][part], got.missing[2][part].tolist(), strict=True)) == \
            Counter(L.key_of(w) for w, k in zip(words, at, strict=True) if k < 0)
    assert len(L.encode([], L.Coder(v)).words) == 0


def test_training_learns_a_pattern():
    """After a, b follows; noise-contrastive scores come close to normalised ones."""
    ids = [np.array(([1, 2] * 30) + [0], np.int16) for _ in range(200)]
    shares = np.array([200, 6000, 6000, 600, 600], float)
    t = L.Trainer(L.Model.start(shares, 8, 3), shares, noise=64, rate=0.1, seed=3)
    for _ in range(3):
        for c, s in L._batches(iter(ids), 512):
            t.step(c, s)
    p = np.exp(L.Model(t.m.R, t.m.C, t.m.Q, t.m.b).log_probabilities(np.array([[1, 2, 1]], np.int16), np.array([2])))
    assert p[0] > 0.9


def test_batches_are_the_contexts_of_whole_texts():
    r = np.random.default_rng(0)
    ids = [r.integers(0, 9, n).astype(np.int16) for n in (1, 2, 50, 3, 1, 17)]
    want = [(tuple(c), s) for x in ids for c, s in zip(L.contexts_of(x).tolist(), x.tolist(), strict=True)]
    for size in (1, 4, 7, 1000):
        got = [(tuple(c), s) for cs, ss in L._batches(iter(ids), size) for c, s in zip(cs.tolist(), ss.tolist(), strict=True)]
        assert got == want
    assert want[3][0] == (0, 0, 0) and want[5][0] == (want[4][1], want[3][1], 0)


def test_parts_and_keys(monkeypatch):
    text = ("wörter und mehr \t\n AİB " * 500 + "x" * 5000 + " end").encode()
    want = text.lower().split()
    monkeypatch.setattr(L, "PART_BYTES", 64)
    assert [w for p in L.parts(text) for w in p] == want
    assert L.key_of(b"x" * 40) == b"x" * 40 and len(L.key_of(b"x" * 5000)) == 33 and L.key_of(b"x" * 41)[:1] == b" "


def test_edges(spark):
    got = L.score_texts(edge_frame(spark), dim=4, rounds=2)
    rows = [(r.doc_id, r.text) for r in edge_frame(spark, clashes=False).collect()]
    want = order(plain_base(rows))
    have = order([tuple(r) for r in got.collect()])
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert all(h[5] == pytest.approx(w[5], rel=1e-9) and math.isfinite(h[6]) for h, w in zip(have, want, strict=True))
    clash = edge_frame(spark).selectExpr("*", *[f"'x' as {c}" for c in (
        "held_out", "row", "slice", "ids", "word", "n", "base", "tail", "missing", "symbols", "m", "logs", "known", "weight")
        if c not in CLASHES])
    assert L.score_texts(clash, dim=4, rounds=1).count() == len(rows)


def test_nothing_or_everything_held_out(spark):
    assert L.score_texts(empty_frame(spark)).count() == 0
    out = [i for i in range(200) if is_out(i)][:3]
    rows = [(i, "all of these are held out") for i in out]
    got = L.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), dim=4, rounds=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 and math.isfinite(r.score) for r in got)
