"""KNN imputation (F5) that meets only near donors.

Rows with the same columns present share a pattern.  Inside a pattern, donors are
put on a space-filling curve and cut into blocks, and a block into ``PARTS`` at its widest
gaps, so that no part spans two clusters.  A part knows the range of every
column, and ``FAN`` parts in a row make a node of the next level up.  The nan-Euclidean
distance of a query to any donor of a node is at least the scaled gap to its ranges over
the columns that both have.  A query first goes to the nearest block of every pattern,
which bounds its kth distances, and then to the nodes whose gap is within that bound.

Donors that agree on all columns of a query are equally far and only the first k ids
of them count.  Where that leaves few donors to the queries of a pattern, these have an index of their own."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .neighbors import _met
from .running import running_sums

BLOCK, PARTS, FAN = 128, 4, 32
#: Most frequent patterns of queries whose donors are looked at apart.
PATTERNS = 8
#: Numbers of one matrix of a kernel.
CELLS = 2_000_000


def _matrix(col: pd.Series) -> np.ndarray:
    """Rows of numbers; null is NaN."""
    return np.array([np.array([np.nan if v is None else v for v in x], float) for x in col.to_numpy()], float)


def _scaled(qp: pd.DataFrame, rp: pd.DataFrame, high: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, distances) of queries to ranges ``rv`` .. ``high``: 0 inside, infinite between
    different cells and where no column is shared."""
    Q, lo, hi = _matrix(qp["qv"]), _matrix(rp["rv"]), _matrix(rp[high])
    qm, rm, d = ~np.isnan(Q), ~np.isnan(lo), Q.shape[1]
    Q, lo, hi = np.nan_to_num(Q), np.nan_to_num(lo), np.nan_to_num(hi)
    qc, rc = qp["cell"].to_numpy(), rp["cell"].to_numpy()
    step = max(1, CELLS // max(len(lo), 1))
    for s in range(0, len(Q), step):
        x, m = Q[s:s + step], qm[s:s + step]
        sq = np.zeros((len(x), len(lo)))
        for j in range(d):
            gap = np.maximum(np.maximum(lo[None, :, j] - x[:, j, None], x[:, j, None] - hi[None, :, j]), 0)
            sq += gap * gap * (m[:, j, None] & rm[None, :, j])
        shared = m.astype(float) @ rm.T.astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.sqrt(d / shared * sq)
        dist[(shared == 0) | (qc[s:s + step, None] != rc[None, :])] = np.inf
        yield s, dist


def _useful(qp: pd.DataFrame, rp: pd.DataFrame, s: int, n: int) -> np.ndarray:
    """Whether a range has a column that the query lacks."""
    lacks = np.isnan(_matrix(qp["qv"].iloc[s:s + n])).astype(float)
    return lacks @ (~np.isnan(_matrix(rp["rv"]))).T.astype(float) > 0


def _nearest_donors(k: int) -> Callable:
    """For every missing value of a query, the k nearest donors of its cell that have it."""
    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(qp) and len(rp):
            R, lacks = _matrix(rp["rv"]), np.isnan(_matrix(qp["qv"]))
            qids, rids = qp["qid"].to_numpy(np.int64), rp["rid"].to_numpy(np.int64)
            for s, dist in _scaled(qp, rp, "rv"):
                for f in range(R.shape[1]):
                    asks, has = np.flatnonzero(lacks[s:s + len(dist), f]), np.flatnonzero(~np.isnan(R[:, f]))
                    if not len(asks) or not len(has):
                        continue
                    part = dist[np.ix_(asks, has)]
                    kth = np.partition(part, min(k, len(has)) - 1, axis=1)[:, min(k, len(has)) - 1]
                    row, col = np.nonzero((part <= kth[:, None]) & np.isfinite(part))
                    far = part[row, col]
                    order = np.lexsort((rids[has[col]], far, row))
                    row, col, far = row[order], col[order], far[order]
                    top = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
                    at = has[col[top]]
                    out.append((qids[s + asks[row[top]]], np.full(top.sum(), f, np.int32), rids[at], far[top], R[at, f]))
        return pd.DataFrame(dict(zip(("qid", "feat", "rid", "dist", "val"), (np.concatenate(x) for x in zip(*out, strict=True)),
                                     strict=True)))
    return kernel


def _descent(nearest: bool) -> Callable:
    """To the nearest useful node of every pattern, or to all useful ones within the bound."""
    def kernel(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        keep = ["qid", "qv", "bound"]
        out = [qp[keep].iloc[:0].assign(pattern="", up=np.zeros(0, np.int64))]
        if len(qp) and len(rp):
            node, bound, pattern = rp["rid"].to_numpy(np.int64), qp["bound"].to_numpy(float), rp["pattern"].to_numpy()
            cells = [np.flatnonzero((pattern == p) & (rp["cell"] == c)) for p, c in set(zip(pattern, rp["cell"], strict=True))]
            for s, dist in _scaled(qp, rp, "hi"):
                dist[~_useful(qp, rp, s, len(dist))] = np.inf
                if nearest:
                    picks = [(r := np.flatnonzero(np.isfinite(dist[:, at].min(1))), at[dist[np.ix_(r, at)].argmin(1)]) for at in cells]
                    row, col = (np.concatenate(x) for x in zip(*picks, strict=True))
                else:
                    row, col = np.nonzero(np.isfinite(dist) & (dist <= bound[s:s + len(dist), None] * (1 + 1e-9) + 1e-12))
                out.append(qp[keep].iloc[s + row].assign(pattern=pattern[col], up=node[col]))
        return pd.concat(out)
    return kernel


def _curve(vec: str, d: int, stats) -> Column:
    """A place on a Z-curve over the columns, squeezed around their means so that far values do no harm."""
    bits = max(1, min(12, 60 // d))
    code = F.lit(0).cast("long")
    for j in range(min(d, 60)):
        z = (F.get(vec, F.lit(j)) - F.lit(float(stats[f"m{j}"] or 0.0))) / F.lit(float(stats[f"s{j}"] or 0.0) or 1.0)
        cell = F.floor((z / (F.abs(z) + 1) + 1) / 2 * F.lit(float((1 << bits) - 1)))
        cell = F.coalesce(cell, F.lit(0)).cast("long")
        for b in range(bits):
            bit = F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long"))
            code = code + F.shiftleft(bit, b * min(d, 60) + j)
    return code


def _parted(spread: np.ndarray) -> Callable:
    """Rows of a block with the part of it that they fall into when it is cut at its widest gaps."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows["rv"])[:, spread > 0] / spread[spread > 0]
        sets = [np.arange(len(x))]
        while len(sets) < PARTS and x.shape[1]:
            best = (0.0, 0, 0, 0)
            for i, at in enumerate(sets):
                ordered = np.sort(np.nan_to_num(x[at]), axis=0)
                gaps = np.diff(ordered, axis=0)
                if gaps.size and gaps.max() > best[0]:
                    r, c = np.unravel_index(gaps.argmax(), gaps.shape)
                    best = (gaps.max(), i, c, (ordered[r, c] + ordered[r + 1, c]) / 2)
            if best[0] == 0:
                break
            _, i, c, cut = best
            at = sets.pop(i)
            low = np.nan_to_num(x[at, c]) <= cut
            sets += [at[low], at[~low]]
        part = np.zeros(len(x), np.int64)
        for i, at in enumerate(sets):
            part[at] = i
        return rows.assign(up=rows["block"] * PARTS + part)[["rid", "rv", "pattern", "block", "up"]]
    return run


def _pattern(vec: str, d: int) -> Column:
    return F.concat(*[F.when(F.get(vec, F.lit(j)).isNull(), "0").otherwise("1") for j in range(d)])


def first_of_equals(donors: DataFrame, pattern: str, k: int) -> DataFrame:
    """The donors (row, rid, rv) that rows with the columns of ``pattern`` can take: of those that
    agree on these columns, the k first ids with a value, for every column that is missing."""
    present = [F.get("rv", F.lit(j)) for j in range(len(pattern))]
    w = Window.partitionBy(*[x for x, p in zip(present, pattern, strict=True) if p == "1"]).orderBy("rid", "row")
    found = None
    for x in (x for x, p in zip(present, pattern, strict=True) if p == "0"):
        some = donors.where(x.isNotNull()).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")
        found = some if found is None else found.unionByName(some)
    return found.dropDuplicates(["row"]) if pattern.count("0") > 1 else found


class DonorIndex:
    """Blocks of donors by pattern, and the levels of nodes over them, all written tables."""

    def __init__(self, donors: DataFrame, d: int):
        """``donors`` are (rid, rv) with null where a value is missing."""
        present = [F.get("rv", F.lit(j)) for j in range(d)]
        self.stats = donors.agg(*[F.avg(x).alias(f"m{j}") for j, x in enumerate(present)],
                                *[F.stddev_pop(x).alias(f"s{j}") for j, x in enumerate(present)],
                                *[F.count(x).alias(f"n{j}") for j, x in enumerate(present)]).first()
        rows = written(donors.select("rid", "rv", _pattern("rv", d).alias("pattern"), _curve("rv", d, self.stats).alias("code"),
                                     F.lit(1).cast("long").alias("one")), "donors")
        sizes = rows.groupBy("pattern").agg(F.count("*").alias("n"))
        placed = running_sums(rows, ["pattern"], ["code", "rid"], ["one"]).join(sizes, "pattern")
        blocks = F.ceil(F.col("n") / BLOCK)  # of equal sizes, so that none is much smaller than the others
        placed = placed.select("rid", "rv", "pattern", F.floor((F.col("cum_one") - 1) * blocks / F.col("n")).alias("block"))
        spread = np.array([self.stats[f"s{j}"] or 0.0 for j in range(d)])
        self.rows = written(placed.groupBy("pattern", "block").applyInPandas(
            _parted(spread), "rid long, rv array<double>, pattern string, block long, up long"), "donor-parts")
        ranges = [f for j in range(d) for f in (F.min(F.get("rv", F.lit(j))).alias(f"l{j}"), F.max(F.get("rv", F.lit(j))).alias(f"h{j}"))]
        lo, hi = F.array(*[f"l{j}" for j in range(d)]), F.array(*[f"h{j}" for j in range(d)])
        node = written(self.rows.groupBy("pattern", F.col("up").alias("rid")).agg(*ranges).select(
            "pattern", "rid", lo.alias("rv"), hi.alias("hi")), "donor-nodes")
        self.levels = []  # from the root on, (pattern, up, rid, rv, hi)
        while True:
            self.levels.insert(0, written(node.withColumn("up", F.expr(f"rid div {FAN}")), "donor-level"))
            if (self.levels[0].agg(F.max("rid")).first()[0] or 0) < FAN:
                break
            up = [f for j in range(d) for f in (F.min(F.get("rv", F.lit(j))).alias(f"l{j}"), F.max(F.get("hi", F.lit(j))).alias(f"h{j}"))]
            node = self.levels[0].groupBy("pattern", F.col("up").alias("rid")).agg(*up).select(
                "pattern", "rid", lo.alias("rv"), hi.alias("hi"))

    def leaves(self, queries: DataFrame, nearest: bool) -> DataFrame:
        """Written (qid, qv, bound, pattern, up): the blocks that queries (qid, qv, bound) go to."""
        at = queries.withColumn("up", F.lit(0).cast("long"))
        for i, level in enumerate(self.levels):  # the roots of all patterns meet all queries
            at = written(_met(at, level, ["pattern", "up"] if i else ["up"], 4096, _descent(nearest),
                              "qid long, qv array<double>, bound double, pattern string, up long",
                              ("qid", "qv", "bound"), ("rid", "rv", "hi", "pattern")), "impute-queries")
        return at

    def donors(self, visits: DataFrame, k: int, by: str = "up") -> DataFrame:
        return _met(visits, self.rows, ["pattern", by], 4096, _nearest_donors(k),
                    "qid long, feat int, rid long, dist double, val double")


def knn_impute(df: DataFrame, features: Sequence[str], id_col: str, k: int = 5,
               donors: DataFrame | None = None) -> DataFrame:
    """every missing feature value becomes the mean of that feature over
    the k nearest donors having it, by nan-Euclidean distance
    √(d / present · Σ_present (x−y)²) over coordinates present in both rows
    (ties by donor id).  A cell with no usable donor gets the donor mean.
    ``donors`` defaults to the frame itself (fit on train: pass the train rows)."""
    feats = list(features)
    donors = df if donors is None else donors

    def values(d: DataFrame) -> Column:
        return F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in feats])
    d = len(feats)
    asks = df.where(F.exists(values(df), lambda v: v.isNull())).select(F.col(id_col).cast("long").alias("qid"), values(df).alias("qv"))
    q = written(asks.groupBy("qid", "qv").agg(F.count("*").alias("times")).withColumn("pattern", _pattern("qv", d)), "rows-to-impute")
    rows = written(donors.select(F.col(id_col).cast("long").alias("rid"), values(donors).alias("rv"),
                                 F.monotonically_increasing_id().alias("row")), "donor-rows")
    means = rows.agg(F.count("*").alias("rows"), *[F.avg(F.get("rv", F.lit(j))).alias(f"m{j}") for j in range(d)]).first()
    found = df.sparkSession.createDataFrame([], "qid long, feat int, rid long, dist double, val double")
    apart = []
    for r in q.groupBy("pattern").count().orderBy(F.desc("count"), "pattern").limit(PATTERNS).collect():
        if "1" not in (p := r["pattern"]):
            apart.append(p)  # no column is shared with any donor
            continue
        few = written(first_of_equals(rows, p, k), "first-of-equals")
        if 2 * few.count() <= means["rows"]:
            apart.append(p)
            for some in impute_candidates(q.where(F.col("pattern") == p).select("qid", "qv"), DonorIndex(few, d), k):
                found = found.unionByName(some)
    rest = q.where(~F.col("pattern").isin(apart)).select("qid", "qv")
    if not rest.isEmpty():
        for some in impute_candidates(rest, DonorIndex(rows, d), k):
            found = found.unionByName(some)
    # donors count once for every time that a row is repeated
    more = q.where("times > 1").groupBy("qid").agg(F.max("times").alias("times"))
    found = found.join(more, "qid", "left").withColumn("again", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    w = Window.partitionBy("qid", "feat").orderBy("dist", "rid")
    fill = (found.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
            .groupBy("qid", "feat").agg(F.avg("val").alias("fill")))
    wide = fill.groupBy("qid").pivot("feat", list(range(len(feats)))).agg(F.first("fill"))
    j = df.join(wide, df[id_col].cast("long") == wide["qid"], "left")
    outs = []
    for c in df.columns:
        if c in feats:
            i = feats.index(c)
            x = F.col(c).cast("double")
            outs.append(F.when(x.isNull() | F.isnan(x), F.coalesce(F.col(f"`{i}`"), F.lit(means[f"m{i}"])))
                        .otherwise(x).alias(c))
        else:
            outs.append(df[c])
    return j.select(*outs)


def impute_candidates(q: DataFrame, index: DonorIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """(donors of the further blocks, donors of the first blocks) of queries (qid, qv)."""
    home = index.leaves(q.withColumn("bound", F.lit(float("inf"))), nearest=True)
    home = home.select("qid", "qv", "pattern", F.expr(f"up div {PARTS}").alias("block")).distinct()
    first = written(index.donors(home, k, "block"), "first-donors")
    d = sum(c.startswith("n") for c in index.stats.asDict())
    w = Window.partitionBy("qid", "feat").orderBy("dist", "rid")
    kth = first.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).groupBy("qid", "feat").agg(
        F.max("dist").alias("far"), F.count("*").alias("got"))
    # a column that has fewer than k donors at all is complete with these
    most = F.get(F.array(*[F.lit(min(k, index.stats[f"n{j}"])) for j in range(d)]), F.col("feat"))
    bounds = kth.groupBy("qid").agg(F.max(F.when(F.col("got") >= most, F.col("far")).otherwise(float("inf"))).alias("bound"),
                                    F.count("*").alias("known"))
    lacks = F.aggregate(F.transform("qv", lambda v, j: (v.isNull() & (F.get(
        F.array(*[F.lit(index.stats[f"n{i}"] > 0) for i in range(d)]), j))).cast("int")), F.lit(0), lambda a, x: a + x)
    asked = q.join(bounds, "qid", "left").select("qid", "qv", F.when(F.col("known") >= lacks, F.col("bound")).otherwise(
        float("inf")).alias("bound"))
    further = index.leaves(asked, nearest=False).withColumn("block", F.expr(f"up div {PARTS}")).join(
        home.select("qid", "pattern", "block"), ["qid", "pattern", "block"], "left_anti")
    return index.donors(further, k), first
