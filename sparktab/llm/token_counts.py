"""Exact token counts with a map-side two-tier lookup.

SentencePiece BPE merges never cross a boundary in front of a word start (no
piece holds the word-start mark after another character) nor a character that
occurs in no piece.  A text is therefore the concatenation of independent
pre-tokens, and its count is the sum of theirs.

Tier one is a broadcast table pre-token → length of the most frequent
pre-tokens of the whole corpus, found from one bounded heavy-hitter summary per
task (no pre-token is ever shuffled).  Tier two is a bounded cache in each
Python worker, filled by encoding what tier one misses.  Both tiers hold the
library's own answers, so they change the speed and never the counts."""
from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_frame, written

#: The mark that SentencePiece puts in place of a space.
MARK = "▁"
SPACED = re.compile(r" +[^ \n]*|\n[^ \n]*")
#: Longer pre-tokens are encoded each time and never kept, which bounds both tiers in bytes.
KEPT_CHARS = 48

COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                       T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def pretokens(text: str) -> list[str]:
    """The independent parts of a text: a line end with the word glued to it, or
    a word whose leading space (the encoder's dummy one for the first) is left
    out.  Further spaces stay in front of their word."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " ":
        return text.replace("\n", " \n").split(" ")
    return [p[1:] if p[0] == " " else p for p in SPACED.findall(" " + text)]


class Encoder:
    """Lengths of pre-tokens under one SentencePiece model."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not self.sp.is_byte(i)]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError(f"{model_path}: a piece crosses a pre-token boundary")
        self.newline = self.sp.encode_as_ids("\n")[-1]

    def lengths(self, parts: list[str]) -> list[int]:
        """All parts in one call, each on its own line."""
        ids = self.sp.encode_as_ids("".join(p if p[:1] == "\n" else f"\n {p}" for p in parts))
        at = [i for i, x in enumerate(ids) if x == self.newline] + [len(ids)]
        return [b - a - (p[:1] != "\n") for p, a, b in zip(parts, at, at[1:], strict=False)]


#: Tier two of this worker process, by model and tier one.
_WORKER: dict[tuple[str, str], "Lengths"] = {}


class Lengths:
    """Tier one is never dropped; tier two is filled on misses and emptied when full."""

    def __init__(self, frequent: dict[str, int], encoder: Encoder, cached: int):
        self.table, self.frequent, self.encoder = dict(frequent), frequent, encoder
        self.most = len(frequent) + cached

    def count(self, text: str) -> int:
        parts = pretokens(text)
        lengths = list(map(self.table.get, parts))
        if None not in lengths:
            return sum(lengths)
        missed = list(dict.fromkeys(p for p, n in zip(parts, lengths, strict=True) if n is None))
        new = dict(zip(missed, self.encoder.lengths(missed), strict=True))
        total = sum(n if n is not None else new[p] for p, n in zip(parts, lengths, strict=True))
        if len(self.table) + len(new) > self.most:
            self.table = dict(self.frequent)
        self.table.update((p, n) for p, n in new.items() if len(p) <= KEPT_CHARS)
        return total


@lru_cache(maxsize=2)
def encoder(model_path: str) -> Encoder:
    return Encoder(model_path)


def trim(counts: Counter, entries: int) -> None:
    """Misra-Gries: subtract the first dropped count from all, keep what is left."""
    if len(counts) > entries:
        cut = sorted(counts.values(), reverse=True)[entries]
        for k in [k for k, n in counts.items() if n <= cut]:
            del counts[k]
        for k in counts:
            counts[k] -= cut


def _summaries(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts = pretokens(text)
                counts.update(parts if max(map(len, parts), default=0) <= KEPT_CHARS
                              else [p for p in parts if len(p) <= KEPT_CHARS])
                if len(counts) > 16 * entries:
                    trim(counts, 8 * entries)
        trim(counts, entries)
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))],
            ["pretokens", "counts"])
    return run


def _merged(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                counts.update(dict(zip(keys.as_py(), n.as_py(), strict=True)))
                trim(counts, 4 * entries)
        trim(counts, entries)
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))],
            ["pretokens", "counts"])
    return run


def frequent_pretokens(texts: DataFrame, entries: int, fan_in: int = 16) -> list[str]:
    """The ``entries`` heaviest pre-tokens of all texts, most frequent first.

    Each task emits one summary of at most ``entries`` pre-tokens; summaries
    meet ``fan_in`` at a time until one is left, so no task or driver ever holds
    more than a fixed number of entries."""
    schema = "pretokens array<string>, counts array<bigint>"
    rows = written(texts.mapInArrow(_summaries(entries), schema), "pretoken-summaries")
    left = rows.count()
    while left > 1:
        left = -(-left // fan_in)
        rows = written(rows.repartition(left).mapInArrow(_merged(entries), schema), "pretoken-summaries")
    top: Counter = Counter()
    for r in rows.collect():
        top.update(dict(zip(r.pretokens, r.counts, strict=True)))
    return [k for k, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[:entries]]


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, frequent: int = 16_384, cached: int = 500_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    ``model_path`` names a SentencePiece model readable on every executor.
    ``frequent`` entries of at most ``KEPT_CHARS`` characters are broadcast (about
    2 MB at most); each worker caches up to ``cached`` more.

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated
    rows and ids are counted one by one; an empty table gives an empty result;
    very long texts are never cut."""
    spark = docs.sparkSession
    texts = text_frame(docs, id_col, text_col)
    top = frequent_pretokens(texts.select("text"), frequent)
    enc = encoder(model_path)
    sent = spark.sparkContext.broadcast(dict(zip(top, enc.lengths(top), strict=True)))
    key = (model_path, uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Lengths(sent.value, encoder(model_path), cached)
        lengths = _WORKER[key]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                n_bytes.append(len(text.encode()))
                n_tokens.append(lengths.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_())], COUNTS.names)

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COUNTS)
