"""Benchmark decontamination with spaced seeds.

Texts are lower-cased word tokens.  Three fixed masks look at six of eight
neighbouring tokens and ignore the other two, so a hit survives substitutions at
the ignored places; a fourth looks at six in a row.  However the two words that may
differ in 13 tokens lie, one of the four sees neither; items of ten to twelve tokens,
which have less room, get masks of their own, and shorter ones than eight are
compared whole.  Training seeds that pass a filter of the benchmark's seeds
(of bounded size) are joined with them on the seed; every joined diagonal is then
verified without gaps: a benchmark item leaks into a document if on a diagonal
``window`` aligned tokens (or the whole item, if shorter) agree in at least
``identity`` of their places.

Only seeds that pass the filter leave the tasks, with the tokens around them;
the filter makes the join small and the join makes it exact."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_frame, written

WORD = re.compile(r"\w+")
#: The masks: 1 is compared, 0 is ignored.
MASKS = ("11101011", "11010111", "10111101")
SPAN = len(MASKS[0])
RUN = "111111"
#: More masks of six tokens by the tokens of the item: what the others miss when the
#: whole item may differ in two words (found by trying all patterns).
SHORT_MASKS = {10: ("110011011", "101100111"), 11: ("11100000111",), 12: ("101001111",)}
#: Items shorter than a span have one mask, all their tokens.
WHOLE = tuple("1" * n for n in range(SPAN))
#: Items of so many tokens and more have the same masks.
ALIKE = 13
#: Odd multipliers of the compared places and of the masks, from the digits of a hash.
_ODD = [xxhash.xxh64_intdigest(b"place %d" % i) | 1 for i in range(ALIKE)]
_MIX = {m: xxhash.xxh64_intdigest(f"mask {m}") | 1 for m in (*MASKS, *WHOLE, *(m for x in SHORT_MASKS.values() for m in x))}
#: Bits of the filter: at least and at most (8 MB), and per seed.
LEAST_BITS, MOST_BITS, BITS_PER_SEED = 1 << 20, 1 << 26, 512


class Hashes(dict):
    """64-bit hashes of words, kept for the worker's life up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = Hashes()


def token_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def item_masks(n: int) -> tuple[str, ...]:
    """The masks that find an item of ``n`` tokens."""
    if n < SPAN:
        return (WHOLE[n],) if n else ()
    return (*MASKS, RUN, *SHORT_MASKS.get(n, ()))


def mask_seeds(tokens: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """For each mask the seed at every position where it fits."""
    placed = [tokens[i:] * np.uint64(_ODD[i]) for i in range(min(len(tokens), max(map(len, masks), default=0)))]
    out = []
    for mask in masks:
        n = max(0, len(tokens) - len(mask) + 1)
        seed = np.zeros(n, np.uint64)
        if n:
            for i, x in enumerate(mask):
                if x == "1":
                    seed += placed[i][:n]
            seed ^= seed >> np.uint64(29)
            seed *= np.uint64(_MIX[mask])
            seed ^= seed >> np.uint64(32)
        out.append(seed)
    return out


def seeds(tokens: np.ndarray) -> np.ndarray:
    """One row per spaced mask: the seed at every position where the span fits."""
    return np.stack(mask_seeds(tokens, MASKS))


def _slots(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (seed & np.uint64(bits - 1)).astype(np.int64), (seed >> np.uint64(38)).astype(np.int64) & (bits - 1)


def _benchmark(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, tokens, seeds, places) of every item that has a mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [token_hashes(t) for t in batch.column(2).to_pylist()]
            found = [mask_seeds(t, item_masks(len(t))) for t in tokens]
            none = [np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64())),
                 pa.array([np.concatenate(none + f).view(np.int64) for f in found], pa.list_(pa.int64())),
                 pa.array([[i for s in f for i in range(len(s))] for f in found], pa.list_(pa.int64()))],
                ["item", "item_id", "tokens", "seeds", "places"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("string").alias("item_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "item bigint, item_id string, tokens array<bigint>, seeds array<bigint>, places array<bigint>")
    return written(out.where(F.size("seeds") > 0), "benchmark")


def _filter(seed_rows: DataFrame) -> np.ndarray:
    """A bit table with two bits per seed, at most ``MOST_BITS`` large."""
    n = seed_rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_SEED * n - 1).bit_length() if n else 0))
    words: np.ndarray = np.zeros(bits // 32, np.uint32)
    slot = F.explode(F.array(F.col("seed").bitwiseAND(F.lit(bits - 1)),
                             F.shiftrightunsigned("seed", 38).bitwiseAND(F.lit(bits - 1)))).alias("slot")
    table = seed_rows.select(slot).groupBy(F.shiftright("slot", 5).alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    got = table.toPandas()
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return words


def _regions(docs: DataFrame, table: np.ndarray, masks: tuple[str, ...], reach: int) -> DataFrame:
    """(doc, doc_id, base, tokens, hits): the tokens around seeds that pass the
    filter, and those seeds; hits that are close share a region."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    schema = "key bigint, doc_id bigint, base bigint, tokens array<bigint>, seed array<bigint>, pos array<bigint>"

    once = [i for i, m in enumerate(masks) if m in WHOLE and m != RUN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        bits = len(words) * 32
        for batch in batches:
            out = []
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = token_hashes(text)
                found = mask_seeds(tokens, masks)
                first = np.cumsum([0, *map(len, found)])
                found = np.concatenate([tokens[:0], *found])
                passed = np.ones(len(found), bool)
                for slot in _slots(found, bits):
                    passed &= (words[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
                at = np.flatnonzero(passed)
                if not len(at):
                    continue
                pos = at - first[np.searchsorted(first, at, "right") - 1]
                order = np.argsort(pos, kind="stable")
                pos, seed = pos[order], found[at[order]]
                if once:  # of a short item's places the first one counts
                    short = np.isin(np.searchsorted(first, at[order], "right") - 1, once)
                    keep = ~short
                    keep[np.flatnonzero(short)[np.unique(seed[short], return_index=True)[1]]] = True
                    pos, seed = pos[keep], seed[keep]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(pos) > 2 * reach) + 1, [len(pos)]])
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    lo, hi = max(0, pos[a] - reach), min(len(tokens), pos[b - 1] + SPAN + reach)
                    out.append((key, doc_id, int(lo), tokens[lo:hi].view(np.int64), seed[a:b].view(np.int64), pos[a:b]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["key", "doc_id", "base", "tokens", "seed", "pos"])

    out = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long"), "text") \
        .mapInArrow(run, schema)
    return written(out.withColumn("region", F.monotonically_increasing_id()), "regions")


def aligned(doc: np.ndarray, item: np.ndarray, diagonal: int, window: int, identity: float):
    """(matches, first, last) of the leaked stretch of ``doc`` on a diagonal, or None.

    ``diagonal`` is where the item's first token would stand in ``doc``."""
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    width = min(window, len(item))
    if hi - lo < width:
        return None
    same = doc[lo:hi] == item[lo - diagonal:hi - diagonal]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[width:] - total[:-width] >= identity * width)
    if not len(good):
        return None
    first, last = good[0], good[-1] + width
    return int(total[last] - total[first]), int(lo + first), int(lo + last)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", window: int = 13,
               identity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_matched, n_item, token_start, token_end, key): one row per
    document row and benchmark item that leaks into it, for the best diagonal.

    With the given window and identity no leak is missed; the masks are not made for
    other values, which may lose some of the leaks with several substitutions.

    ``key`` is the 64-bit hash of (doc_id, text).  Null and empty texts hold no
    token and leak nothing; items with fewer than eight tokens leak where all their
    tokens stand, for with one replaced they cannot be told from chance, and an item
    without tokens leaks nowhere; null ids stay null; equal (id,
    text) rows are reported once; of equally good diagonals the first counts;
    empty tables give an empty result; very long texts are searched whole."""
    items = _benchmark(benchmark, item_col, item_text_col)
    seed_rows = items.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("x")) \
        .select("item", F.col("x.seeds").alias("seed"), F.col("x.places").alias("ipos"))
    sizes = items.groupBy(F.least(F.size("tokens"), F.lit(ALIKE)).alias("n")).agg(F.max(F.size("tokens")).alias("most")).collect()
    masks = tuple(dict.fromkeys(m for x in sorted(sizes) for m in item_masks(x.n)))
    reach = max((x.most for x in sizes), default=0)
    regions = _regions(text_frame(docs, id_col, text_col), _filter(seed_rows), masks, reach)
    hits = regions.select("region", F.explode(F.arrays_zip("seed", "pos")).alias("h")) \
        .select("region", F.col("h.seed").alias("seed"), F.col("h.pos").alias("pos"))
    diagonals = hits.join(seed_rows, "seed").select("region", "item", (F.col("pos") - F.col("ipos")).alias("diagonal")) \
        .distinct()
    rows = diagonals.join(items.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item") \
        .join(regions.select("region", "key", "doc_id", "base", "tokens"), "region")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = {n: batch.column(n) for n in batch.schema.names}
            out = []
            for i in range(batch.num_rows):
                item = b["item_tokens"][i].values.to_numpy()
                base = b["base"][i].as_py()
                got = aligned(b["tokens"][i].values.to_numpy(), item, b["diagonal"][i].as_py() - base, window, identity)
                if got:
                    out.append((b["key"][i].as_py(), b["doc_id"][i].as_py(), b["item"][i].as_py(),
                                b["item_id"][i].as_py(), got[0], len(item), base + got[1], base + got[2]))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["key", "doc_id", "item", "item_id", "n_matched", "n_item", "s", "e"])

    checked = rows.mapInArrow(verify, "key bigint, doc_id bigint, item bigint, item_id string, n_matched bigint, "
                                      "n_item bigint, s bigint, e bigint")
    best = checked.groupBy("key", "doc_id", "item").agg(
        F.min(F.struct((-F.col("n_matched")).alias("m"), "s", "e", "item_id", "n_item")).alias("x"))
    return best.select("doc_id", "x.item_id", (-F.col("x.m")).alias("n_matched"), "x.n_item",
                       F.col("x.s").alias("token_start"), F.col("x.e").alias("token_end"), "key")


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item leaks into, columns unchanged."""
    found = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("key").distinct()
    found = written(found, "contaminated")  # its true size decides how it is joined
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(found, key == found["key"], "left_anti")
