import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sparktab.llm import pii
from tests.conftest import SF_CHECK

from .helpers import edge_frame, stored
from .test_decontaminate import brute as leaks
from .test_simhash import components, plain_fingerprint


def brute(spark, docs):
    """The pipeline's decisions one document at a time, except for the learned models' fits."""
    kept = {r.doc_id: r.text for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    group = components({i: plain_fingerprint(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if group[i] == i}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    near = [(i, t) for i, t in kept.items() if any(b[:20] in t or b[-20:] in t for _, b in bench)]
    gone = {d for d, _ in leaks(near, bench)}
    return {i: t for i, t in kept.items() if i not in gone}


def test_stages_match_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    want = brute(spark, docs)
    got = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = corpus_pipeline.written(stage(spark, got, SF_CHECK), name)
        assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == want
    model = pii.fit(got)
    masked = {i: pii.masked(t, model.spans(t)) for i, t in want.items()}
    after = corpus_pipeline.written(corpus_pipeline.mask_personal_data(spark, got, SF_CHECK), "pii")
    assert after.columns == docs.columns and {r.doc_id: r.text for r in after.collect()} == masked
    rows = corpus_pipeline.run(spark, SF_CHECK).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = set()
    for i, t in masked.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        pieces |= {(i, p, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes()))
                   for p, s in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)


def test_edges(spark, tmp_path):
    df = stored(spark, edge_frame(spark), tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, df, SF_CHECK), name)
        assert out.columns == df.columns
    assert corpus_pipeline.pack_sequences(spark, df, SF_CHECK).count() >= 10
    empty = stored(spark, df.limit(0), tmp_path / "empty")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_CHECK).count() == 0
