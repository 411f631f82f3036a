"""Best-fit-decreasing packing with certified lower bounds.

Documents become token pieces of at most ``capacity``; pieces that fill a
sequence alone are done.  The rest is dealt into partitions of a bounded number
of pieces, each packed by best-fit decreasing.  Dual-feasible functions bound
the number of sequences any packing of a partition needs: a partition that meets
its bound is certified.  Partitions with a gap give up their sequences that
are not full; these pieces are dealt out anew, so that partitions exchange
documents, and packed again, until nothing has a gap or a round saves no sequence."""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_frame, written

SEPARATOR = b"\0\0\0\0"
#: Longer words are encoded each time and never kept, which bounds a worker's cache in bytes.
KEPT_BYTES = 48


#: A word of Latin letters and marks behind it: both are pre-tokens, and NFC leaves them as they are.
SIMPLE = re.compile(r"([a-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
#: Byte-level alphabets show a byte that is no printable Latin-1 character as the next one from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class WordIds:
    """Token ids (little-endian 32-bit) of the words between ASCII white space.

    For a tokenizer that lower-cases, treats white space only as a boundary and
    has no token across one, a text's ids are its words' ids put together.  Texts
    that might hold a special token's string go to the library whole."""

    def __init__(self, tokenizer_path: str, cached: int = 500_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.known: dict[bytes, bytes] = {}
        self.cached = cached

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in
                (self.tok.encode(t, add_special_tokens=False) for t in texts)]

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        simple = SIMPLE.fullmatch(text)
        if not simple:
            return self._encode([text])[0]
        parts = simple.groups()
        if not text.isascii():
            parts = [p.lower().encode().decode("latin-1").translate(BYTE_CHARS) for p in parts]
        ids = [t.id for p in parts if p for t in self.model.tokenize(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special) or "<|" in text:
            return self._encode([text])[0]
        words = text.encode().lower().split()  # ASCII only, as the tokenizer does with these letters
        got = list(map(self.known.get, words))
        if None in got:
            missed = list(dict.fromkeys(w for w, x in zip(words, got, strict=True) if x is None))
            new = dict(zip(missed, map(self._word, missed), strict=True))
            got = [x if x is not None else new[w] for w, x in zip(words, got, strict=True)]
            if len(self.known) + len(new) > self.cached:
                self.known.clear()
            self.known.update((w, x) for w, x in new.items() if len(w) <= KEPT_BYTES)
        return b"".join(got)


@lru_cache(maxsize=2)
def word_ids(tokenizer_path: str) -> WordIds:
    return WordIds(tokenizer_path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, *, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's token ids and
    the separator id 0, cut every ``capacity`` ids."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + \
        ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path).ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + SEPARATOR
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in list(zip(cols, types, strict=True))[:5 + with_ids]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + with_ids])

    texts = text_frame(docs, id_col, text_col)
    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of every item and the fill of every bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    rooms = 0  # bit r is set if some open bin has room r
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += need
        room -= need
        if room:
            free[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best dual-feasible-function bound on the number of bins.

    Taken over the identity, the rounding family u(k) for k to 40, and the
    threshold family that counts items above capacity − t whole and items below
    t as nothing, for every t up to half the capacity."""
    if not len(lengths):
        return 0
    size = np.arange(capacity + 1)
    n = np.bincount(lengths, minlength=capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    for k in range(1, 41):
        x = (k + 1) * size
        # scaled by k·capacity: x itself where (k+1)·x/capacity is whole, else its floor
        value = np.where(x % capacity == 0, k * size, x // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    t = np.arange(0, capacity // 2 + 1)
    above = n[::-1].cumsum()  # above[j]: items of at least capacity − j
    weight = np.concatenate([[0], (n * size).cumsum()])
    large = np.where(t > 0, above[np.maximum(t - 1, 0)], 0)
    middle = weight[capacity - t + 1] - weight[t]
    return max(best, int((large + -(-middle // capacity)).max()))


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        rows["bin"], rows["offset"] = bins, offsets
        rows["certified"] = len(fill) == lower_bound(lengths, capacity)
        rows["full"] = fill[bins] == capacity
        return rows
    return run


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False, partition_pieces: int = 50_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset, certified), one row per piece.

    ``certified`` says that the piece's partition met its lower bound (a full
    sequence always does).  ``partition_pieces`` bounds what one task packs;
    there are as many partitions as the pieces need.

    Null and empty texts are one piece that holds the separator alone; a null id
    stays null; repeated rows are packed as pieces of their own; very long texts
    are cut only every ``capacity`` ids; equal lengths go by piece number; an
    empty table gives an empty result."""
    pieces = token_pieces(docs, tokenizer_path, capacity, id_col=id_col, text_col=text_col, with_ids=with_ids)
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    keys = ["uid", "length"]
    alone = pieces.where(F.col("length") == capacity).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("certified"))
    placed = [alone]
    left = pieces.where(F.col("length") < capacity).select(*keys)
    number, before, rounds = left.count(), None, 0
    while number:
        groups = -(-number // partition_pieces)
        dealt = left.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(rounds)), F.lit(groups)))
        out = written(dealt.groupBy("g").applyInPandas(
            _pack(capacity), "uid bigint, length bigint, g bigint, bin bigint, offset bigint, "
                             "certified boolean, full boolean"), "packed")
        sequence = F.col("bin") + F.col("g") * (1 << 20) + F.lit(rounds << 56)
        done = out.select("uid", sequence.alias("sequence_id"), "offset",
                          (F.col("certified") | F.col("full")).alias("certified"))
        gap = ~F.col("certified") & ~F.col("full")
        open_ = out.where(gap).agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if not open_[0] or groups == 1 or (before is not None and open_[1] >= before):
            placed.append(done)
            break
        placed.append(done.where("certified"))
        left, number, before, rounds = out.where(gap).select(*keys), open_[0], open_[1], rounds + 1
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    return pieces.join(where, "uid").drop("uid")
