import zlib

import numpy as np

from sparktab.llm import language_id as li
from tests.conftest import SF_CHECK

from .helpers import edge_frame, empty_frame


def naive(text, dim, seed):
    """One trigram at a time, as defined."""
    out, word = np.zeros(dim), []
    for c in [*text.lower(), " "]:
        if c.isalpha():
            word.append(ord(c))
            continue
        padded = [0, *word, 0]
        for a, b, c3 in zip(padded, padded[1:], padded[2:], strict=False):
            v = [li._letter_vector(x, dim, seed) for x in (a, b, c3)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        word = []
    return out


def test_bundles_are_the_definition():
    texts = ["Abc ab", "", "x1y  ab!", "日本語 テキスト", "ÉÀ é", "a" * 50, "12 34"]
    got = li.bundles(texts, 64, 7)
    assert all((g == naive(t, 64, 7)).all() for g, t in zip(got, texts, strict=True))
    grouped = li.bundles(texts, 64, 7, np.array([0, 1, 0, 1, 0, 1, 0]), 2)
    assert (grouped[0] == got[::2].sum(0)).all() and (grouped[1] == got[1::2].sum(0)).all()


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "some words " * 300
    whole = li.bundles([text], 64, 1)[0]
    monkeypatch.setattr(li, "PART_CHARS", 100)
    assert (li._encoded([text], 64, 1)[0] == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    profiles = li.learn_profiles(docs, ~li.held_out(docs["doc_id"]))
    rows = li.predict_languages(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_training_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").where("doc_id < 200")
    a = li.learn_profiles(docs.repartition(1), docs["doc_id"] >= 0, dim=64)
    b = li.learn_profiles(docs.repartition(7), docs["doc_id"] >= 0, dim=64)
    assert a.languages == b.languages and (a.vectors == b.vectors).all()


def test_edges(spark):
    df = edge_frame(spark)
    profiles = li.learn_profiles(df, ~li.held_out(df["doc_id"]), dim=64)
    rows = li.predict_languages(df, profiles).collect()
    assert len(rows) == 10
    assert sorted(r.doc_id for r in rows if r.lang_pred == "und" and r.doc_id is not None) == [2, 3, 5, 6]
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert li.known_language_only(df, profiles).count() <= 5
    empty = empty_frame(spark)
    none = li.learn_profiles(empty, li.held_out(empty["doc_id"]))
    assert none.languages == [] and {r.lang_pred for r in li.predict_languages(df, none).collect()} == {"und"}
    assert li.predict_languages(empty_frame(spark), profiles).count() == 0


def test_known_languages_are_those_that_are_predicted(spark):
    text = "xylo"
    unlike = li.Profiles(["aa"], -li.bundles([text], 64, 42).astype(np.float64), 42)
    df = spark.createDataFrame([(1, text), (2, "12 !"), (3, None), (4, "")], "doc_id long, text string")
    assert unlike.predict([text]) == (["aa"], [0.0])
    predicted = {r.doc_id for r in li.predict_languages(df, unlike).collect() if r.lang_pred != "und"}
    assert {r.doc_id for r in li.known_language_only(df, unlike).collect()} == predicted == {1}
