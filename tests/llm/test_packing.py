import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from sparktab.llm.packing import WordIds, best_fit_decreasing, lower_bound, pack
from tests.conftest import SF_CHECK

from .helpers import LONG, edge_frame, empty_frame, strings

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"AbÉ é'’.,!?<|1२\x1c\x85\xa0　 ΣςİŞſK\n\t ", "don't", "THE ", "<|startoftext|>", "<|EndOfText|>",
            "<|endoftext|>", " ́", "é", "가", "가"]


@pytest.fixture(scope="module")
def words():
    return WordIds(TOKENIZER, cached=60)


def library_ids(words, text):
    return words.tok.encode(text, add_special_tokens=False).ids


def test_word_ids_are_the_library_ids(words):
    for t in strings(2, ALPHABET, 4000, 14):
        assert np.frombuffer(words.ids(t), "<u4").tolist() == library_ids(words, t), t


def optimum(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bound_is_below_and_packing_above_the_optimum():
    r = random.Random(3)
    for _ in range(200):
        c = r.choice([10, 16, 23])
        lengths = np.array(sorted((r.randint(1, c) for _ in range(r.randint(1, 8))), reverse=True))
        bins, offsets, fill = best_fit_decreasing(lengths, c)
        assert lower_bound(lengths, c) <= optimum(lengths.tolist(), c) <= len(fill)
        assert fill.max() <= c and (np.bincount(bins, lengths) == fill).all()
    assert lower_bound(np.zeros(0, np.int64), 10) == 0
    assert lower_bound(np.array([6, 6, 6]), 10) == 3  # more than half: one each


def check(rows, docs, words, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for d in docs:
        ids = [*library_ids(words, d.text or ""), 0]
        for piece, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want.append((d.doc_id is None, d.doc_id or 0, piece, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return by_sequence


@pytest.mark.parametrize("partition_pieces", [50_000, 40])
def test_documents_pack_near_the_bound(spark, words, partition_pieces):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").where("doc_id < 400")
    rows = pack(docs, TOKENIZER, partition_pieces=partition_pieces).collect()
    sequences = check(rows, docs.collect(), words, 2048)
    bound = lower_bound(np.array([r.length for r in rows]), 2048)
    assert bound <= len(sequences) <= bound * (1.0 if partition_pieces > 40 else 1.04) + 1


def test_edges(spark, words):
    df = edge_frame(spark)
    rows = pack(df, TOKENIZER, capacity=64, with_ids=True).collect()
    check(rows, df.collect(), words, 64)
    assert b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == 4), key=lambda r: r.piece)) == \
        words.ids(LONG) + b"\0\0\0\0"
    assert pack(empty_frame(spark), TOKENIZER).count() == 0
