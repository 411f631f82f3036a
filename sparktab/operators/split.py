"""Reproducible splits, folds and learning-curve subsets (L1-L4).

Rows are ordered by a seeded hash of their key (ties by key), ranked within
their stratum by the sizes of the hash's buckets and their place in their own
bucket (no single-task window even when one class holds most rows), and
assigned by rank against exact sizes:
n_test = ceil(test·n), n_val = ceil(val/(1−test) · (n − n_test)), which a
stratified split shares out over the strata by largest remainder.
The assignment depends only on the key and seed, never on partitioning, so
recomputation after an executor loss reproduces it."""
from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_int
from ..session import shuffle_partitions, written
from .running import ROWS_PER_PART, running_sums, same_keys

#: Leading bits of the 32-bit hash that make a bucket.
BUCKET_BITS = 16


def _dec(x: float) -> F.Column:
    return F.lit(Decimal(str(round(x, 9)))).cast("decimal(20,9)")


def hash_rank(df: DataFrame, key: str, group: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Adds ``_rank`` (0-based within ``group`` in hash order) and ``_n``.

    The rows of lower buckets are counted beforehand, so rows are shuffled once."""
    keys = [*group, "_bucket"]
    x = _bucketed(df, key, seed)
    sizes = written(x.groupBy(*keys).agg(F.count("*").alias("_rows")), "hash-buckets")
    whole = Window.partitionBy(*group)
    lower = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, F.coalesce(F.sum("_rows").over(lower), F.lit(0)).alias("_before"),
                          F.sum("_rows").over(whole).alias("_n"))
    parts = -(-(sizes.agg(F.sum("_rows")).first()[0] or 0) // ROWS_PER_PART)
    if parts > shuffle_partitions(df.sparkSession):
        x = x.repartition(parts, *keys)
    inner = x.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key)))
    out = inner.alias("i").join(before.alias("b"), same_keys("i", "b", keys))
    return out.select(*[F.col(f"i.{c}").alias(c) for c in [*df.columns, "_h"]],
                      (F.col("b._before") + F.col("i._place") - 1).alias("_rank"), F.col("b._n").alias("_n"))


def _bucketed(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds the hash ``_h`` and its bucket, which rise together; rows without a key come first."""
    x = df.withColumn("_h", hash_int(key, seed))
    return x.withColumn("_bucket", F.coalesce(F.shiftright("_h", 32 - BUCKET_BITS), F.lit(-1).cast("bigint")))


def relative_val(test_size: float, val_size: float) -> float:
    return round(val_size / (1.0 - test_size), 9)


def _allot(strata: DataFrame, size: str, total: str, out: str, by: str) -> DataFrame:
    """Adds ``out``: ``total`` rows shared out over the strata in proportion to
    ``size`` by largest remainder (ties by stratum); every stratum keeps a row."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    whole = strata.agg(F.sum(size).alias("_all"))
    x = strata.crossJoin(whole).withColumn("_all", F.greatest("_all", F.lit(1)))
    share = (big(total) * big(size))
    x = x.withColumn("_left", -(share % big("_all")).cast("bigint")).withColumn(
        "_base", F.greatest(F.lit(0), F.least(F.floor(share / big("_all")).cast("bigint"), F.col(size) - 1)))
    x = x.withColumn("_more", (F.col("_base") < F.col(size) - 1).cast("bigint")).drop("_all")
    open_ = running_sums(x.where("_more = 1"), [], ["_left", by], ["_more"], prefix="_nth")
    given = x.agg(F.sum("_base").alias("_given"))
    ranked = x.where("_more = 0").withColumn("_nth_more", F.lit(None).cast("bigint")).unionByName(open_)
    extra = F.coalesce((F.col("_nth_more") <= F.col(total) - F.col("_given")).cast("bigint"), F.lit(0))
    return ranked.crossJoin(given).withColumn(out, F.col("_base") + extra).drop(
        "_left", "_base", "_more", "_nth_more", "_given")


def stratum_sizes(df: DataFrame, target: str, test_size: float, val_size: float) -> DataFrame:
    """(target, n_test, n_val): exact totals ceil(test·n) and ceil(val/(1−test)·rest),
    shared out by largest remainder; a stratum always keeps a training row, so
    strata of one go to train (and where too few rows are free, less is taken)."""
    strata = written(df.groupBy(target).agg(F.count("*").alias("_size")), "strata")
    n = F.sum("_size")
    test = strata.agg(F.ceil(_dec(test_size) * n).cast("bigint").alias("_total"))
    x = written(_allot(strata.crossJoin(test), "_size", "_total", "n_test", target).drop("_total"), "strata")
    x = x.withColumn("_size", F.col("_size") - F.col("n_test"))
    val = x.agg(F.ceil(_dec(relative_val(test_size, val_size)) * n).cast("bigint").alias("_total"))
    return _allot(x.crossJoin(val), "_size", "_total", "n_val", target).select(target, "n_test", "n_val")


def assign_split(df: DataFrame, key: str, target: str | None = None, stratify: bool = False,
                 test_size: float = 0.2, val_size: float = 0.1, seed: int = 42) -> DataFrame:
    """L1/L2: adds ``split`` ∈ {train, val, test}; stratified on ``target``
    when ``stratify``."""
    if stratify and target:
        sizes = stratum_sizes(df, target, test_size, val_size)
        r = hash_rank(df, key, [target], seed)
        r = r.alias("r").join(sizes.alias("s"), same_keys("r", "s", [target])).select("r.*", "n_test", "n_val")
    else:
        return _split_by_buckets(df, key, test_size, val_size, seed)
    split = (F.when(F.col("_rank") < F.col("n_test"), "test")
             .when(F.col("_rank") < F.col("n_test") + F.col("n_val"), "val").otherwise("train"))
    return r.withColumn("split", split).drop("_h", "_rank", "_n", "n_test", "n_val")


def _split_by_buckets(df: DataFrame, key: str, test_size: float, val_size: float, seed: int) -> DataFrame:
    """``split`` without a shuffle of the rows: a bucket of the hash on one side of
    both borders goes there as a whole, and only the two at most that hold a border are ranked."""
    x = _bucketed(df, key, seed)
    rows = sorted(x.groupBy("_bucket").agg(F.count("*").alias("n")).collect())  # at most 2^16 + 1
    n = F.col("n")
    n_test = F.ceil(_dec(test_size) * n)
    sizes = df.sparkSession.createDataFrame([(sum(r["n"] for r in rows),)], "n bigint").select(
        n_test.cast("bigint"), F.ceil(_dec(relative_val(test_size, val_size)) * (n - n_test)).cast("bigint")).first()
    borders, last, cut, before = (sizes[0], sizes[0] + sizes[1]), [-2, -2], {}, 0
    for bucket, size in rows:
        for i, border in enumerate(borders):
            if before + size <= border:
                last[i] = bucket
            elif before < border:
                cut[bucket] = before
        before += size

    def by(c: str, test, val):
        return F.when(F.col(c) < test, "test").when(F.col(c) < val, "val").otherwise("train")
    inside = F.col("_bucket").isin(list(cut))
    out = (x.where(~inside) if cut else x).withColumn("split", by("_bucket", last[0] + 1, last[1] + 1))
    if cut:
        start = F.coalesce(*[F.when(F.col("_bucket") == b, F.lit(at)) for b, at in cut.items()])
        place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key))
        ranked = x.where(inside).withColumn("_rank", start + place - 1)
        out = out.unionByName(ranked.withColumn("split", by("_rank", *borders)).drop("_rank"))
    return out.drop("_h", "_bucket")


def assign_folds(df: DataFrame, key: str, k: int = 5, target: str | None = None,
                 seed: int = 42) -> DataFrame:
    """L3: ``fold`` = hash rank mod k (within class when ``target``)."""
    r = hash_rank(df, key, [target] if target else [], seed)
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_h", "_rank", "_n")


def learning_curve_subsets(df: DataFrame, key: str, n_sizes: int = 8, low: float = 0.1,
                           seed: int = 42) -> DataFrame:
    """L4: nested prefixes of the hash order at fractions linspace(low, 1,
    n_sizes); a row is replicated into every subset that contains it
    (bounded by n_sizes copies)."""
    spark = df.sparkSession
    fr = [low + i * (1.0 - low) / (n_sizes - 1) for i in range(n_sizes)]
    sizes = spark.createDataFrame([(i, float(f)) for i, f in enumerate(fr)], "size_idx int, fraction double")
    r = hash_rank(df, key, [], seed)
    j = r.crossJoin(F.broadcast(sizes))
    return j.where(F.col("_rank") < F.ceil(F.col("fraction") * F.col("_n"))).drop("_h", "_rank", "_n")


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count("*").cast("bigint").alias("rows"))
