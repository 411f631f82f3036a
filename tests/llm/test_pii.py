import re

import numpy as np

from sparktab.llm import pii
from tests.conftest import SF_CHECK

from .helpers import edge_frame, empty_frame, strings

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return sorted(out + [("phone", *m.span()) for m in PHONE.finditer(t)
                         if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_base_spans_follow_the_contract():
    parts = [*"a@.@.-+1 2(0)9\n٣é:", "1.2.3.4", "@b.c", "4111 1111 1111 1111", "+1 (017) 555-7713", " at ",
             "(555) 555-1234", "0" * 20 + "1.2.3.256"]
    for t in strings(4, parts, 5000, 25):
        assert sorted((c.kind, c.start, c.end) for c in pii.candidates(t) if c.base) == plain(t), t


def test_very_long_runs_are_linear():
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "a@" * 50_000):
        pii.candidates(t)


def test_em_recovers_reliabilities():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.85, 0.6])
    votes = np.stack([np.where(r.random(len(truth)) < q, truth, ~truth) * 2 for q in right], 1)
    codes, counts = np.unique((votes * 3 ** np.arange(5)).sum(1), return_counts=True)
    given, post, prior = pii.estimate(pii._vote_table(codes), counts.astype(float))
    assert abs(prior - 0.7) < 0.02
    assert np.abs(given[1, :, 2] - right).max() < 0.03
    assert ((post >= 0) & (post <= 1)).all()


def test_classifier_adds_what_looks_like_the_accepted(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    model = pii.fit(docs)
    rows = {r.doc_id: r for r in pii.find_pii(docs, model).collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        base = plain(r.text)
        got = rows[r.doc_id]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(got.spans.split(","))
    failing = [c for r in docs.collect() for c in pii.candidates(r.text) if c.kind == "card" and not c.base]
    assert failing and not any(model.accepts(c) for c in failing)  # numbers without a check digit


def test_masking_replaces_spans_once():
    model = pii.Model({}, {})
    text = "x a@b.com, 4111 1111 1111 1111."
    assert pii.masked(text, model.spans(text)) == "x [EMAIL], [CARD]."
    both = [pii.Candidate("card", 2, 8, True, 0, 0), pii.Candidate("phone", 4, 10, True, 0, 0)]
    assert pii.masked("0123456789ab", both) == "01[CARD]ab"


def test_edges(spark):
    df = edge_frame(spark)
    model = pii.fit(df)
    rows = pii.find_pii(df, model).collect()
    assert len(rows) == 10 and all(r.spans == "" for r in rows)
    masked = pii.mask_pii(df, model)
    assert masked.columns == df.columns and masked.where("text is null").count() == 2
    none = pii.fit(empty_frame(spark))
    assert none.weights == {} and pii.find_pii(empty_frame(spark), none).count() == 0
