"""Exact removal of repeated byte strings by merging shard Burrows-Wheeler orders.

A byte goes if a ``length``-byte string over it also starts anywhere else.

1. Every start of such a string is tied to an anchor, the smallest 16-gram hash
   of the ``WINDOW`` positions from it on.  The anchor depends on the string alone,
   so equal strings have it at the same place.  Starts with one anchor form a
   run.  Runs whose core (the bytes from the anchor that all its strings share)
   is met once hold no repeat; runs that are equal as a whole repeat as a whole.
2. What is left are groups of different runs around an equal core.  Their texts are
   put into buckets by core.  In a bucket, shards of a bounded size sort their own
   suffixes once (the row order of their Burrows-Wheeler transforms).  The shard
   orders are merged by refining the interleave: blocks of suffixes that agree in
   h bytes are split by the block ranks of the suffixes h bytes on, where each
   shard's rows are already in order, so that a stable merge is enough.  The
   depth at which two neighbours part is their common prefix; blocks that hold
   together at ``length`` bytes are the repeated intervals.
3. Cores with very many different runs would make a bucket without bound.  Equal
   strings begin equally far before the core, so the runs are cut at the middle of
   these distances: all strings of a half share a longer core.  The pieces are grouped
   by it like runs, and what is met once there holds no repeat; pieces around a core
   that is still crowded are cut again, down to single starts."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

GRAM, WINDOW = 16, 192
#: Bytes of a text that are searched at once; the parts overlap by ``length``.
PART = 1 << 20
#: Bytes that a shard sorts by itself, and bytes of a bucket on average.
SHARD, BUCKET = 1 << 18, 1 << 21


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every position on as a number, in byte order ``order``."""
    return np.ndarray(len(data) - 7, f"{order}u8", data, strides=(1,)).astype(np.uint64)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every position on."""
    word = _words(data, "<")
    a = word[:-8] * np.uint64(0x9E3779B97F4A7C15) + word[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    a ^= a >> np.uint64(31)
    return a * np.uint64(0xD6E8FEB86659FD93)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(v) - width + 1
    pad = -len(v) % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1:width - 1 + n])


def anchored_runs(raw: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, first start, last start) of every run of starts in a text."""
    for at in range(0, len(raw) - length + 1, PART):
        data = np.frombuffer(raw[at:at + PART + length - 1], np.uint8)
        starts = len(data) - length + 1
        grams = _grams(data)
        place = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_min(place, WINDOW)[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.concatenate([first[1:] - 1, [starts - 1]])
        for a, lo, hi in zip(anchor[first].tolist(), first.tolist(), last.tolist(), strict=True):
            yield at + a, at + lo, at + hi


def shard_order(data: np.ndarray, at: np.ndarray, length: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes ``at`` of one shard in order of their first ``length`` bytes."""
    return interleave(data, at, length, wanted, "quicksort")[1]


def _steps(n: int, length: int) -> list[tuple[int, list[int]]]:
    """(new depth, places of the further ranks that lead to it), three ranks at once where they fit 64 bits."""
    parts = 3 if (n + 2) ** 3 < 1 << 64 else 2
    depth, steps = 8, []
    while depth < length:
        to = min(parts * depth, length)
        steps.append((to, sorted({min(depth, to - depth), to - depth})))
        depth = to
    return steps


def interleave(data: np.ndarray, rows: np.ndarray, length: int, wanted: np.ndarray | None = None,
               kind: str = "stable") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Refine blocks of suffixes to depth ``length``.

    ``rows`` are suffix positions, shard after shard, each shard in its own
    order (or in any order, which sorts one shard, for which ``kind`` may be
    "quicksort").  Returns (block rank of every position, the interleaved rows,
    for each of these the depth to which it is known to agree with the row before).
    If ``wanted`` marks positions, only these are refined to ``length``, and others
    as deep as the marked ones need."""
    n = len(data)
    key = _words(np.concatenate([data, np.zeros(7, np.uint8)]), ">")
    rank = np.zeros(n + length, np.uint64)  # the end of the text comes first
    order = rows[np.argsort(key[rows], kind=kind)]
    key = key[order]
    split = np.concatenate([[True], key[1:] != key[:-1]])[:len(order)]
    rank[order] = np.maximum.accumulate(np.where(split, np.arange(len(order)), 0)) + 1
    common = np.where(split, 0, 8)
    steps = _steps(n, length)
    needs = [np.ones(n, bool) if wanted is None else wanted]
    for _, further in reversed(steps[1:]):
        need = needs[-1].copy()
        for o in further:
            need[o:] |= needs[-1][:-o]
        needs.append(need)
    live = np.zeros(n, bool)
    for (depth, further), need in zip(steps, reversed(needs), strict=True):
        places = np.flatnonzero(need[order])
        held = rank[order[places]]
        tied = held[1:] == held[:-1]
        places = places[np.concatenate([[False], tied])[:len(held)] | np.concatenate([tied, [False]])[:len(held)]]
        if not len(places):  # no block is left that is not settled
            break
        act = order[places]
        if kind == "stable":
            live[:] = False
            live[act] = True
            act = rows[live[rows]]  # still shard after shard, each in its own order
        key = rank[act]
        for o in further:
            key = key * np.uint64(n + 2) + rank[act + o]
        merged = np.argsort(key, kind=kind)
        act, key = act[merged], key[merged]
        order[places] = act
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        rank[act] = np.maximum.accumulate(np.where(differs, places, 0)) + 1
        common[places[~differs]] = depth
    return rank[:n].astype(np.int64) - 1, order, common


def repeated_starts(contexts: list[bytes], widths: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its first ``widths`` starts have an equal string among all of them."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    cuts = [0]
    for i, b in enumerate(begin.tolist()):
        if b - begin[cuts[-1]] >= SHARD:
            cuts.append(i)
    cuts.append(len(contexts))
    starts = np.concatenate([np.arange(b, b + w) for b, w in zip(begin, widths, strict=True)])
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    orders = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = int(begin[a]), int(begin[b - 1] + sizes[b - 1])
        orders.append(lo + shard_order(data[lo:hi], np.arange(hi - lo), length, wanted[lo:hi]))
    rank, _, _ = interleave(data, np.concatenate(orders), length, wanted)
    met = np.bincount(rank[starts], minlength=len(data))
    again = met[rank[starts]] > 1
    return np.split(again, np.cumsum(widths)[:-1])


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]


RUN = "core bigint, whole bigint, lead int, width int, row binary, start bigint"
CLASS = ["core", "whole", "lead", "width"]
INTERVALS = "array<struct<a:int,b:int>>"


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text: the same wherever and whenever the row is read."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), text)))


def _runs(docs: DataFrame, length: int) -> DataFrame:
    core_bytes = length - WINDOW + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, whole = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for a, lo, hi in anchored_runs(raw, length):
                    for col, x in zip(out, (core(raw[a:a + core_bytes]), whole(raw[lo:hi + length], 7),
                                            a - lo, hi - lo + 1, row, lo), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(out[0], np.uint64).view(np.int64)), pa.array(np.array(out[1], np.uint64).view(np.int64)),
                 pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()),
                 pa.array(out[5], pa.int64())], ["core", "whole", "lead", "width", "row", "start"])
    return docs.mapInArrow(run, RUN)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs, by class."""
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct(*CLASS, "start", "hot")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for row, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row == last:  # the joined rows come by key, so a repeated row is read once a task
                    continue
                last, raw = row, text.encode()
                out += [(r["core"], r["whole"], r["lead"], r["width"], r["hot"],
                         raw[r["start"]:r["start"] + r["width"] + length - 1]) for r in runs]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             [*CLASS, "hot", "bytes"])

    return docs.join(by_row, "row").select("row", "text", "runs").mapInArrow(
        run, "core bigint, whole bigint, lead int, width int, hot boolean, bytes binary")


def _merge_bucket(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*CLASS, "at"]).reset_index(drop=True)
        flags = repeated_starts(rows["bytes"].tolist(), rows["size"].tolist(), length)
        rows["found"] = [[{"a": at + a, "b": at + b} for a, b in _intervals(f)]
                         for at, f in zip(rows["at"].tolist(), flags, strict=True)]
        return rows.loc[[bool(x) for x in rows["found"]], [*CLASS, "found"]]
    return run


def _halves(pieces: DataFrame, length: int, span: int) -> DataFrame:
    """Pieces of runs, cut at the middle of the ``span`` distances from the core that begin at ``low``.

    A piece is the part of ``run`` with the starts ``at`` to ``at + width - 1``, of which
    the first is ``lead`` bytes before the anchor."""
    half = -(-span // 2)
    made = pa.schema([("at", pa.int32()), ("low", pa.int32()), ("lead", pa.int32()), ("width", pa.int32()),
                      ("bytes", pa.binary()), ("core", pa.int64()), ("whole", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, whole = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for batch in batches:
            of, out = [], []
            for i, (at, low, lead, width, raw) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                for near, far in ((low, low + half - 1), (low + half, low + span - 1)):
                    first, last = max(lead - far, 0), min(lead - near, width - 1)
                    if first <= last and near <= far:
                        shared, piece = raw[lead - near:lead - far + length], raw[first:last + length]
                        of.append(i)
                        out.append((at + first, near, lead - first, last - first + 1, piece,
                                    _signed(core(shared, near)), _signed(whole(piece, 7))))
            cols = list(zip(*out, strict=True)) or [[]] * len(made)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int32())), *(pa.array(c, f.type) for c, f in zip(cols, made, strict=True))],
                ["run", *made.names])

    return pieces.select("run", "at", "low", "lead", "width", "bytes").mapInArrow(
        run, "run struct<core:bigint,whole:bigint,lead:int,width:int>, at int, low int, lead int, width int, "
             "bytes binary, core bigint, whole bigint")


def _crowded(contexts: DataFrame, length: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(pieces around cores that are not crowded, starts found already) of runs around crowded cores."""
    calm, found, span = [], [], WINDOW
    pieces = contexts.select(F.struct(*CLASS).alias("run"), F.lit(0).alias("at"), F.lit(0).alias("low"), "lead", "width", "bytes")
    while span > 1 and not pieces.isEmpty():
        cut = written(_halves(pieces, length, span), "halves")
        span = -(-span // 2)
        classes = written(cut.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min(F.struct("run", "at")).alias("one")), "piece-classes")
        groups = classes.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
        mixed = classes.join(groups, "core").select(*CLASS, "one.run", "one.at", (F.col("kinds") > crowd).alias("hot"))
        same = cut.join(classes.where("n > 1").select(*CLASS), CLASS, "left_semi")
        found.append(same.select("run.*", F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("width") - 1).alias("b")))
                                 .alias("found")))
        left = written(cut.join(mixed, [*CLASS, "run", "at"]), "pieces")  # one of equal pieces is enough
        calm.append(left.where(~F.col("hot")).select("run.*", "at", F.col("width").alias("size"), F.col("core").alias("key"), "bytes"))
        pieces = left.where("hot")
    return calm, found


def removed_starts(docs: DataFrame, length: int, crowd: int) -> DataFrame:
    """(row, a, b): intervals of starts whose string also starts elsewhere."""
    runs = written(_runs(docs, length), "runs")
    classes = runs.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("one"))
    classes = written(classes, "run-classes")
    groups = classes.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = written(classes.join(groups, "core").select(*CLASS, "n", "one.row", "one.start",
                                                        (F.col("kinds") > crowd).alias("hot")), "mixed-runs")
    same = runs.join(classes.where("n > 1").select(*CLASS), CLASS, "left_semi") \
        .select("row", F.col("start").alias("a"), (F.col("start") + F.col("width") - 1).alias("b"))
    contexts = written(_contexts(docs, mixed, length), "contexts")
    pieces, found = _crowded(contexts.where("hot"), length, crowd)
    calm = contexts.where(~F.col("hot")).select(*CLASS, F.lit(0).alias("at"), F.col("width").alias("size"), F.col("core").alias("key"),
                                                "bytes")
    for more in pieces:
        calm = calm.unionByName(more)
    total = calm.agg(F.sum(F.length("bytes"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("key"), F.lit(-(-total // BUCKET) or 1))
    merged = calm.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(
        _merge_bucket(length), f"core bigint, whole bigint, lead int, width int, found {INTERVALS}")
    for more in found:
        merged = merged.unionByName(more)
    single = mixed.where("n = 1").join(merged, CLASS).select("row", "start", F.explode("found").alias("x")) \
        .select("row", (F.col("start") + F.col("x.a")).alias("a"), (F.col("start") + F.col("x.b")).alias("b"))
    return same.union(single)


def kept_bytes(raw: bytes, intervals: list[tuple[int, int]], length: int) -> tuple[bytes, int]:
    """(what is left of ``raw``, number of maximal removed runs)."""
    out, at, spans = [], 0, 0
    for a, b in sorted(intervals):
        if not spans or a > at:
            out.append(raw[at:a])
            spans += 1
        at = max(at, b + length)
    out.append(raw[at:])
    return b"".join(out), spans


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   crowd: int = 1000, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per input row.

    Rows are told apart by a 128-bit digest of id and text, so nothing depends on how
    the table is dealt into splits when it is read again.  Runs around cores with more
    than ``crowd`` different ones are cut into pieces first; the result is the same.  ``with_text`` adds the bytes that are left.

    Null text counts as empty; a null id stays null; repeated rows are documents
    of their own, so each of two equal long texts goes whole; texts shorter than
    ``length`` lose nothing; very long texts are searched in overlapping parts; an
    empty table gives an empty result."""
    if length < WINDOW + GRAM - 1:
        raise ValueError(f"length must be at least {WINDOW + GRAM - 1}")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = named.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    starts = removed_starts(named.select("row", "text"), length, crowd)
    # equal rows have equal intervals, so the set of them is bounded by the text
    by_row = written(starts.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("gone")), "removed-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                kept, spans = kept_bytes(raw, [(g["a"], g["b"]) for g in gone or ()], length)
                out.append((doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in list(zip(cols, types, strict=True))[:5 + with_text]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 + with_text])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" \
        + ", kept binary" * with_text
    return named.join(by_row, "row", "left").select("doc_id", "text", "gone").mapInArrow(run, schema)
