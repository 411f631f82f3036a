"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints within ``max_bits`` of each other, cut into ``max_bits // 2 + 1``
segments, differ by at most one bit in some segment.  Each fingerprint is
indexed under every segment with every single bit of it left out; two segments
that differ in at most one bit share such a variant.  An equality join on the
variants gives the candidates, whose bit distance is checked in the join.

A variant under which very many fingerprints stand is cut again: what the
other bits may differ by falls into halves in the same way, so its rows join on
finer variants.  Only distinct fingerprints are joined, and a fingerprint has a
bounded number of others within the distance, so links grow with the input."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.operators.components import connected_components

from .common import text_frame, written

#: Hashes whose bits are laid out at once.
BLOCK = 1 << 16


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """The 64-bit SimHash of a text's word shingles as a signed number; 0 without words."""
    words = text.encode().lower().split()  # both treat ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in
                       zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], "<u8")
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at:at + BLOCK].view(np.uint8), bitorder="little")
        set_ += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp), one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for at in range(0, batch.num_rows, 256)
                   for t in batch.column(1).slice(at, 256).to_pylist()]  # few texts at a time as Python strings
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    texts = text_frame(docs, id_col, text_col)
    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _bits(low: int, width: int) -> int:
    """A mask of ``width`` bits from ``low`` as a signed 64-bit number."""
    mask = ((1 << width) - 1) << low
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masked(fp: str, mask: int) -> Column:
    return F.col(fp).bitwiseAND(F.lit(mask))


def _cut(low: int, width: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` nearly equal segments (low bit, width)."""
    edges = [low + width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _variants(segments: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(segment, left-out bit, mask) of every one-wildcard variant."""
    return [(s, bit, _bits(low, width) & ~(1 << bit) if bit < 63 else _bits(low, width - 1))
            for s, (low, width) in enumerate(segments) for bit in range(low, low + width)]


def _first_variant(segments: list[tuple[int, int]], x: Column, used: Column) -> Column:
    """True for the one variant number under which a pair with difference ``x`` counts:
    the first segment that differs in at most one bit, and there the bit that
    differs, or the lowest if none does."""
    best = F.lit(-1)
    first = 0
    cases = []
    for low, width in segments:
        part = x.bitwiseAND(F.lit(_bits(low, width)))
        at = F.when(part == 0, F.lit(first))
        for i in range(width):
            at = at.when(part == F.lit(_bits(low + i, 1)), F.lit(first + i))
        cases.append(at)
        first += width
    return used == F.coalesce(*cases, best)


def links(fps: DataFrame, *, max_bits: int = 2, hot: int = 2000) -> DataFrame:
    """(a, b), a < b, for every two distinct values of ``fp`` within ``max_bits``.

    A variant with more than ``hot`` fingerprints is joined on finer variants;
    the links are the same.  What is laid out in variants is never broadcast: Spark takes
    its size from before, some 65 times too low."""
    segments = _cut(0, 64, max_bits // 2 + 1)
    variants = _variants(segments)
    keyed = fps.select("fp", F.posexplode(F.array(*[_masked("fp", m) for _, _, m in variants])).alias("n", "key"))
    counts = keyed.groupBy("n", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    kept = written(keyed.hint("merge").join(counts, ["n", "key"]), "variants")  # most variants are met by one fingerprint alone
    shared, crowded = kept.where(F.col("rows") <= hot), kept.where(F.col("rows") > hot)

    def joined(rows: DataFrame, on: list[str], extra=None) -> DataFrame:
        a, b = rows.withColumnRenamed("fp", "a").alias("a"), rows.withColumnRenamed("fp", "b").alias("b")
        x = F.col("a.a").bitwiseXOR(F.col("b.b"))
        cond = (F.col("a.a") < F.col("b.b")) & (F.bit_count(x) <= max_bits) \
            & _first_variant(segments, x, F.col("a.n"))
        for c in on:
            cond = (F.col(f"a.{c}") == F.col(f"b.{c}")) & cond
        if extra is not None:
            cond = cond & extra(x)
        return a.hint("merge").join(b, cond).select(F.col("a.a").alias("a"), F.col("b.b").alias("b"))

    found = joined(shared, ["n", "key"])
    if not crowded.isEmpty():
        finer = []
        for s, (low, width) in enumerate(segments):
            others = [half for other in _cut_others(low, width) for half in _cut(*other, max_bits // 2 + 1)]
            numbers = [i for i, (seg, _, _) in enumerate(variants) if seg == s]
            sub = _variants(others)
            rows = crowded.where(F.col("n").isin(numbers)).select(
                "fp", "n", "key", F.posexplode(F.array(*[_masked("fp", m) for _, _, m in sub])).alias("n2", "key2"))
            finer.append(joined(rows, ["n", "key", "n2", "key2"],
                                lambda x, o=others: _first_variant(o, x, F.col("a.n2"))))
        for f in finer:
            found = found.union(f)
    return found


def _cut_others(low: int, width: int) -> list[tuple[int, int]]:
    """The bits outside a segment, as one or two runs."""
    return [r for r in ((0, low), (low + width, 64 - low - width)) if r[1] > 0]


def near_duplicates(docs: DataFrame, *, shingle: int = 3, max_bits: int = 2, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Texts without words (null and empty ones too) have fingerprint zero and link
    like any other; equal texts have equal fingerprints.  ``component_id`` is the
    smallest id that links reach; null ids stay null and are never that
    smallest unless there is no other.  Repeated rows and ids stay; an empty table
    gives an empty result; very long texts are hashed whole."""
    table = written(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col), "fingerprints")
    least = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = written(links(least.select("fp"), max_bits=max_bits), "links")
    parts = connected_components(found, "a", "b")
    rooted = least.join(parts, least["fp"] == parts["node"], "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return table.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: 64-bit words of the filter that lets rows stay without a shuffle: 4 MB at any size of the table.
FILTER_WORDS = 1 << 18


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                      max_bits: int = 2, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` without those near-duplicate to a kept one, columns unchanged.

    Of each component the row with the smallest id stays, of equal ids the one with
    the smallest text digest, of rows equal in both any one; a null id stays only if there is
    no other.  Rows are told apart by id and digest, so nothing depends on how the
    table is dealt into splits when it is read again.  Rows that miss a bit filter of
    the rows to go stay where they are; only the others are shuffled with
    their texts and looked up.  An empty table stays empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for at in range(0, batch.num_rows, 256)
                   for t in batch.column(2).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], ["id", "digest", "fp"])

    read = rows.select("id", _digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text")) \
        .mapInArrow(run, "id bigint, digest binary, fp bigint")
    table = written(read.groupBy("id", "digest", "fp").agg(F.count("*").alias("times")), "rows")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    least = written(table.groupBy("fp").agg(F.min(rank).alias("first"), F.sum("times").alias("times")), "distinct-fingerprints")
    found = written(links(least.select("fp"), max_bits=max_bits), "links")
    parts = connected_components(found, "a", "b")
    rooted = written(least.join(parts, least["fp"] == parts["node"], "left").select(
        "fp", "first", "times", F.coalesce("component", "fp").alias("root")), "rooted")
    stays = rooted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("times").alias("times")).where("times > 1")
    crowded = written(rooted.drop("times").join(stays, "root").select("fp", "stays"), "crowded-fingerprints")
    members = table.join(crowded, "fp")  # one row a fingerprint on the right: AQE can split a common one
    kept = F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("digest") == F.col("stays.digest"))
    gone = written(members.where(~kept | (F.col("times") > 1)).select("id", "digest", kept.alias("once")), "near-duplicates")

    slot = F.pmod(F.xxhash64("id", "digest"), F.lit(FILTER_WORDS * 64))
    words = written(gone.select(F.floor(slot / 64).alias("__word"), _bit(slot).alias("bit")).groupBy("__word").agg(
        F.bit_or("bit").alias("__bits")), "near-duplicate-filter")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__digest": _digest(F.col(text_col))})
    at = F.pmod(F.xxhash64("__id", "__digest"), F.lit(FILTER_WORDS * 64))
    seen = keyed.withColumns({"__word": F.floor(at / 64), "__bit": _bit(at)}).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")), F.lit(0)) != 0
    named = gone.select(F.col("id").alias("__gone_id"), F.col("digest").alias("__gone_digest"), F.col("once").alias("__once"))
    met = F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__digest") == F.col("__gone_digest"))
    hits = seen.where(hit).join(named.hint("merge"), met, "left").where("__once is null or __once")
    hits = written(hits.select(*docs.columns, "__id", "__digest", "__once"), "near-duplicate-candidates")
    alone = hits.where("__once is null").select(*docs.columns)
    one = hits.where("__once").groupBy("__id", "__digest").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return seen.where(~hit).select(*docs.columns).unionByName(alone).unionByName(one.select("__row.*"))
