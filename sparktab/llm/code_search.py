"""Exact top-k Hamming search with incremental multi-index hashing.

A code is cut into 16-bit segments, each with its own index.  A query probes
segment after segment at radius 0, then at radius 1 and so on.  When segments
0..j of m have been probed at radius s and the rest at s − 1, every code within
m·s + j of the query has been met; the query is finished once its kth verified
distance is covered by that.  So the answer is exact, and near codes end early.

Rows are indexed in blocks; queries meet every block, and a query's answers from
the blocks are merged.  Equal codes are searched once, on either side: of a code's
ids only the k smallest others can be among anyone's k nearest."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEGMENT = 16
#: Candidate pairs that are laid out at once.
PAIRS = 1 << 20


def sign_codes(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): one bit per dimension, set where the component is positive, in
    16-bit units; null vectors are left out, null components are not positive,
    and shorter vectors are filled up with unset bits."""
    live = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"),
                                                            F.col(vector_col).alias("v"))
    units = max(1, -(-(live.agg(F.max(F.size("v"))).first()[0] or 1) // SEGMENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            positive = np.nan_to_num(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) > 0
            bits = np.zeros((len(sizes), units * SEGMENT), bool)
            at = np.arange(len(positive)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bits[np.repeat(np.arange(len(sizes)), sizes), at] = positive
            codes = [c.tobytes() for c in np.packbits(bits, axis=1, bitorder="little")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["id", "code"])

    return live.mapInArrow(run, "id bigint, code binary")


@lru_cache(maxsize=SEGMENT + 1)
def _flips(radius: int) -> np.ndarray:
    """All 16-bit masks with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], np.int64)


class SegmentIndex:
    """The codes of one block, findable by the value of every segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # (n, m) 16-bit units
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << SEGMENT))])
                       for j in range(codes.shape[1])]

    def probe(self, queries: np.ndarray, segment: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, distance) of every code first met at this segment and radius."""
        flips = _flips(radius)
        step = max(1, PAIRS // len(flips))
        for a in range(0, len(queries), step):
            values = queries[a:a + step, segment].astype(np.int64)[:, None] ^ flips
            lo, n = self.starts[segment][values], np.diff(self.starts[segment])[values]
            owner = np.repeat(np.arange(a, a + len(values)), n.sum(1))
            lo, n = lo.ravel(), n.ravel()
            for b, e in _slices(n):
                at = np.arange(n[b:e].sum()) - np.repeat(np.cumsum(n[b:e]) - n[b:e], n[b:e])
                rows = self.order[segment][np.repeat(lo[b:e], n[b:e]) + at]
                whose = owner[n[:b].sum():][:len(rows)]
                apart = np.bitwise_count(queries[whose] ^ self.codes[rows]).astype(np.int16)
                least = apart.min(1)
                new = (least == radius) & (apart.argmin(1) == segment)
                yield whose[new], rows[new], apart[new].sum(1)

    def nearest(self, queries: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest codes of every query, ties by id."""
        m = self.codes.shape[1]
        k = min(k, len(self.codes))
        pending = np.arange(len(queries))
        best = [np.zeros(0, np.int64)] * 3
        done: list[list[np.ndarray]] = []
        for radius in range(SEGMENT + 1):
            for segment in range(m):
                for whose, rows, dist in self.probe(queries[pending], segment, radius):
                    best = _keep([np.concatenate([x, y]) for x, y in
                                  zip(best, (pending[whose], rows, dist), strict=True)], k, ids)
                kth = np.full(len(queries), np.iinfo(np.int64).max)
                have = np.bincount(best[0], minlength=len(queries))
                np.maximum.at(far := np.full(len(queries), -1, np.int64), best[0], best[2])
                full = have >= k
                kth[full] = far[full]
                covered = kth <= m * radius + segment
                over = covered[best[0]]
                done.append([x[over] for x in best])
                best = [x[~over] for x in best]
                pending = pending[~covered[pending]]
                if not len(pending):
                    return tuple(np.concatenate(x) for x in zip(*done, strict=True))
        done.append(best)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of probes with about ``PAIRS`` candidates each."""
    total = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        yield a, b
        a = b


def _keep(found: list[np.ndarray], k: int, ids: np.ndarray) -> list[np.ndarray]:
    """The k best rows of every query."""
    whose, rows, dist = found
    order = np.lexsort((ids[rows], dist, whose))
    whose, rows, dist = whose[order], rows[order], dist[order]
    first = np.concatenate([[True], whose[1:] != whose[:-1]]) if len(whose) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(whose)), 0)) if len(whose) else np.zeros(0, np.int64)
    top = np.arange(len(whose)) - start < k
    return [whose[top], rows[top], dist[top]]


def _units(codes: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), "<u2")
    return raw.reshape(len(codes), -1)


def _search(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if index.empty or queries.empty:
            return pd.DataFrame({"qcode": [], "id": [], "distance": []})
        ids = index["id"].to_numpy(np.int64)
        whose, rows, dist = SegmentIndex(_units(index["code"])).nearest(_units(queries["qcode"]), k, ids)
        return pd.DataFrame({"qcode": queries["qcode"].to_numpy()[whose], "id": ids[rows], "distance": dist})
    return run


def top_k(rows: DataFrame, queries: DataFrame, *, id_col: str, vector_col: str, k: int = 10,
          block: int = 1 << 18) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other rows of every query.

    Distances are Hamming distances of sign codes, ties go to the smaller id; a row
    with the query's own id is not its neighbour.  ``block`` bounds the rows and
    the queries of one task.  Rows and queries with a null id or vector are left
    out; rows that repeat id and code count once, an id with several codes counts
    with each of them; fewer than k other rows give fewer answers; empty tables give
    an empty result."""
    live = rows.where(F.col(id_col).isNotNull())
    coded = written(sign_codes(live, id_col, vector_col).distinct(), "codes")
    asked = sign_codes(queries.where(F.col(id_col).isNotNull()), id_col, vector_col) \
        .select(F.col("id").alias("query_id"), F.col("code").alias("qcode")).distinct()
    asked = written(asked, "queries")
    # rows under the query's own id are met and then left out: one, unless ids repeat
    own = coded.join(asked.select("query_id").distinct(), coded["id"] == F.col("query_id")).groupBy("id").count()
    spare = own.agg(F.max("count")).first()[0] or 0
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = written(coded.withColumn("n", nth).where(F.col("n") <= k + spare).select("id", "code"), "entries")
    codes = asked.select("qcode").distinct()
    blocks, parts = -(-entries.count() // block) or 1, -(-codes.count() // block) or 1
    index = entries.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))) \
        .withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sought = codes.withColumn("p", F.pmod(F.xxhash64("qcode"), F.lit(parts)).cast("int")) \
        .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = index.groupBy("b", "p").cogroup(sought.groupBy("b", "p")) \
        .applyInPandas(_search(k + spare), "qcode binary, id bigint, distance int")
    by_code = Window.partitionBy("qcode").orderBy("distance", "id")
    best = found.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k + spare).drop("n")
    by_query = Window.partitionBy("query_id", "qcode").orderBy("distance", "neighbor_id")
    return asked.join(best.withColumnRenamed("id", "neighbor_id"), "qcode") \
        .where("query_id <> neighbor_id").withColumn("rank", F.row_number().over(by_query)) \
        .where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
