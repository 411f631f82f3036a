import public_tokenizers
import pytest
import sentencepiece

from sparktab.llm.token_counts import Encoder, Lengths, count_tokens, pretokens
from tests.conftest import SF_SMALL

from .helpers import edge_frame, empty_frame, strings

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"ab the cd. \n\n   ▁\t\r;)é①\x00　ﬁ", "the", " of", "<s>", "</s>", "<unk>"]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_parts_sum_to_the_library_count(sp):
    lengths = Lengths({}, Encoder(MODEL), 50)  # a small cache, so that it is emptied
    for t in strings(1, ALPHABET, 3000, 30):
        assert lengths.count(t) == len(sp.encode(t)), t


def test_pretokens_keep_every_space():
    assert pretokens("a b") == ["a", "b"]
    assert pretokens("a  b\nc") == ["a", " b", "\nc"]
    assert pretokens("") == []


def test_counts_match_the_library_on_documents(spark, sp):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in count_tokens(docs, MODEL, frequent=200, limit=500).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(sp.encode(r.text))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == \
            (n, len(r.text.encode()), n > 500)


def test_edges(spark, sp):
    df = edge_frame(spark)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(df, MODEL).collect()))
    want = sorted(((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(sp.encode(r.text or "")))
                   for r in df.collect()))
    assert got == want
    assert count_tokens(empty_frame(spark), MODEL).count() == 0
