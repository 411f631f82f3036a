import random
from itertools import combinations

import numpy as np

from sparktab.llm.decontaminate import SPAN, aligned, clean, find_leaks, seeds, token_hashes
from tests.conftest import SF_CHECK

from .helpers import edge_frame, empty_frame

WORDS = [a + b for a in "bcdfghklmnprst" for b in ("al", "en", "or", "it", "um", "ast", "ell")]


def prose(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def brute(docs, items, window=13, identity=0.8):
    out = set()
    for d, text in docs:
        t = token_hashes(text or "")
        for i, item in items:
            w = token_hashes(item or "")
            if len(w) >= SPAN and any(aligned(t, w, k, window, identity) for k in range(-len(w), len(t) + 1)):
                out.add((d, str(i)))
    return out


def test_seeds_ignore_masked_places():
    a = token_hashes("a b c d e f g h")
    b = token_hashes("a b c X e Y g h")
    assert (seeds(a)[:, 0] == seeds(b)[:, 0]).tolist() == [True, False, False]
    assert seeds(token_hashes("a b")).shape == (3, 0)


def test_planted_leaks_and_clean_documents(spark):
    r = random.Random(5)
    items = [(i, prose(r, r.randint(15, 40))) for i in range(12)]
    docs, leaked = [], set()
    for d in range(60):
        body = prose(r, r.randint(0, 80))
        if d % 3 == 0:
            i, words = r.choice(items)
            words = list(words)
            if d % 2:  # one word in seven replaced
                for at in range(d % 5, len(words), 7):
                    words[at] = "zzz"
            at = r.randint(0, len(body))
            body[at:at] = words
            leaked.add((d, str(i)))
        docs.append((d, " ".join(body).title()))
    items = [(i, ", ".join(w)) for i, w in items]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in find_leaks(df, bench).collect()}
    assert got == leaked == brute(docs, items)
    kept = clean(df.selectExpr("*", "1 as key", "2 as item"), bench)
    assert kept.columns == ["doc_id", "text", "key", "item"]
    assert {x.doc_id for x in kept.collect()} == set(range(60)) - {d for d, _ in leaked}


def test_documents_match_brute_force_on_containment(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    bench = spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")
    got = {x.doc_id for x in find_leaks(docs, bench).collect()}
    items = [x.text for x in bench.collect()]
    exact = {x.doc_id for x in docs.collect() if any(i in x.text for i in items)}
    assert exact and exact <= got and len(got) <= 1.2 * len(exact)


def test_all_substitution_patterns_are_found(spark):
    items = [(n, [f"w{n}x{i}" for i in range(n)]) for n in (*range(8, 14), 15, 16)]
    docs = []
    for n, words in items:
        for k in range(5):
            for places in combinations(range(n), k):
                body = ["zzz" if i in places else w for i, w in enumerate(words)]
                docs.append((len(docs), " ".join(["before", *body, "after"])))
    items = [(n, " ".join(words)) for n, words in items]
    want = set()
    for n, item in items:
        want |= brute([x for x in docs if f"w{n}x" in x[1]], [(n, item)])
    got = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want
    assert {n: sum(i == str(n) for _, i in want) for n in (8, 9, 10, 11, 12, 13)} == {8: 9, 9: 10, 10: 56, 11: 67, 12: 79, 13: 92}


def test_short_items_are_found_whole(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(8)] + [(8, "w6x0 w6x1 w6x2 w6x3 w6x4 w6x5 and two")]
    docs = [(d, f"Before {item.title()}, after {item}") for d, item in items]
    docs += [(100 + d, f"before {item.replace('x0', 'x9')} after") for d, item in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_matched, x.token_start, x.token_end) for x in find_leaks(df, bench).collect()}
    want = {(n, str(n)): (n, 1, 1 + n) for n in range(1, 9)} | {(8, "6"): (6, 1, 7), (108, "8"): (7, 1, 9)}
    assert got == want
    assert {x.doc_id for x in clean(df, bench).collect()} == {0, *range(100, 108)}


def test_edges(spark):
    bench = spark.createDataFrame([(1, "words in a very long text words in a very long text words"), (2, None), (None, "x"),
                                   (3, "too short")], "item_id long, text string")
    got = find_leaks(edge_frame(spark), bench).collect()
    assert [(x.doc_id, x.item_id) for x in got] == [(4, "1")]
    assert clean(edge_frame(spark), bench).count() == 9
    assert find_leaks(edge_frame(spark), bench.limit(0)).count() == 0
    assert find_leaks(empty_frame(spark), bench).count() == 0
    assert aligned(np.zeros(3, np.uint64), np.zeros(9, np.uint64), 0, 13, 0.8) is None
