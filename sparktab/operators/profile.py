"""Dataset profiling.

Per-column statistics are computed on the unpivoted (column, value) form:
partial aggregation happens before the shuffle, so the exchange carries one
row per (partition, column) for moments and one row per distinct value for
distinct counts, whatever the row count.  No operator here collects rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import rnd, hist_bin, pearson, unpivot_numeric
from ..functions.keys import hash_int
from .kinds import NUMERIC_TYPES, detect_kinds
from .quantiles import exact_quantiles, quantile_wide, value_counts
from .running import running_sums, sized

# Missing-share bands, near-constant and outlier rules,
# skew flag, category top-k and page size used by the reference views.
MISSING_HIGH = 0.20
MISSING_MEDIUM = 0.05
NEAR_CONSTANT_MIN_UNIQUE = 3
NEAR_CONSTANT_TOP_SHARE = 0.95
IQR_FACTOR = 1.5
SKEW_FLAG = 1.0
TOP_CATEGORIES = 20
PAGE_SIZE = 25


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def is_missing(df: DataFrame, c: str) -> Column:
    """pandas ``isnull``: null, and NaN for floating columns."""
    dt = df.schema[c].dataType
    x = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def _missing_long(df: DataFrame) -> DataFrame:
    flags = df.select(*[is_missing(df, c).cast("int").alias(c) for c in df.columns])
    return flags.unpivot([], df.columns, "column", "m")


def _ordinals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(columns)), "ordinal int, column string")


def missing_values(df: DataFrame) -> DataFrame:
    """A2: (column, missing_count, missing_percentage 2 dp of all rows)."""
    g = _missing_long(df).groupBy("column").agg(F.sum("m").cast("bigint").alias("missing_count"),
                                                 F.count("*").alias("n"))
    return g.select("column", "missing_count",
                    F.coalesce(rnd(F.try_divide(F.col("missing_count") * 100.0, F.col("n")), 2),
                               F.lit(0.0)).alias("missing_percentage"))


def missing_report(df: DataFrame) -> DataFrame:
    """A3: columns with any missing value, ratio, severity band and the
    number of columns above the high band, ordered by ratio."""
    g = _missing_long(df).groupBy("column").agg(F.avg("m").alias("ratio"))
    g = g.where(F.col("ratio") > 0)
    n_high = g.agg(F.count_if(F.col("ratio") > MISSING_HIGH).cast("bigint").alias("n_high_columns"))
    sev = (F.when(F.col("ratio") > MISSING_HIGH, "high")
           .when(F.col("ratio") > MISSING_MEDIUM, "medium").otherwise("low"))
    return (g.crossJoin(F.broadcast(n_high))
            .select("column", rnd("ratio", 6).alias("missing_ratio"), sev.alias("severity"),
                    "n_high_columns")
            .orderBy(F.desc("missing_ratio"), "column"))


def _long_strings(df: DataFrame, columns: Sequence[str], var: str = "column",
                  val: str = "value") -> DataFrame:
    """One scan: every column as text (missing → null), unpivoted."""
    cols = list(columns)
    wide = df.select(*[F.when(~is_missing(df, c), F.col(c).cast("string")).alias(c) for c in cols])
    return wide.unpivot([], cols, var, val).where(F.col(val).isNotNull())


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, non_null, n_unique, top_count) exact; one scan, one shuffle
    of distinct (column, value) pairs after map-side partial counts."""
    columns = list(columns or df.columns)
    vc = _long_strings(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    out = vc.groupBy("column").agg(F.sum("n").cast("bigint").alias("non_null"),
                                   F.count("*").cast("bigint").alias("n_unique"),
                                   F.max("n").cast("bigint").alias("top_count"))
    names = _ordinals(df, columns)
    return (names.join(out, "column", "left")
            .fillna(0, ["non_null", "n_unique", "top_count"]).drop("ordinal"))


def column_cards(df: DataFrame) -> DataFrame:
    """A4: (column, kind, non_null, n_unique)."""
    k = detect_kinds(df).select("column", "kind")
    d = distinct_counts(df)
    return k.join(d, "column").select("column", "kind", "non_null", "n_unique")


def kind_counts(df: DataFrame) -> DataFrame:
    k = detect_kinds(df)
    return k.agg(*[F.count_if(F.col("kind") == n).cast("bigint").alias(f"n_{n}")
                   for n in ("numerical", "categorical", "datetime", "text")])


def dataset_summary(df: DataFrame) -> DataFrame:
    """A1: rows, columns, total missing, missing % (2 dp of cells),
    duplicate rows and the number of columns of each kind."""
    n_cols = len(df.columns)
    miss = _missing_long(df).agg(F.sum("m").cast("bigint").alias("total_missing"))
    rows = df.agg(F.count("*").cast("bigint").alias("rows"))
    groups = df.distinct().agg(F.count("*").cast("bigint").alias("n_groups"))
    j = rows.crossJoin(miss).crossJoin(groups).crossJoin(kind_counts(df))
    return j.select(
        "rows", F.lit(n_cols).cast("bigint").alias("columns"), "total_missing",
        F.when(F.col("rows") * n_cols > 0,
               rnd(F.col("total_missing") * 100.0 / (F.col("rows") * n_cols), 2))
        .otherwise(F.lit(0.0)).alias("missing_percentage"),
        (F.col("rows") - F.col("n_groups")).alias("duplicate_rows"),
        "n_numerical", "n_categorical", "n_datetime", "n_text")


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Occurrences after the first of each distinct row (nulls equal)."""
    cols = list(subset or df.columns)
    g = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A5: count, mean, sample std, min, exact 25/50/75 % (linear), max."""
    cols = list(columns or numeric_columns(df))
    long = unpivot_numeric(df, cols)
    v = F.col("value")
    long = long.where(v.isNotNull() & ~F.isnan(v))
    m = long.groupBy("column").agg(
        F.count("*").cast("bigint").alias("count"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantile_wide(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return m.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def correlation(df: DataFrame, columns: Sequence[str] | None = None,
                chunk: int = 200) -> DataFrame:
    """Pearson r for every ordered pair (long form), pairwise complete;
    null for a constant column.  Empty when fewer than two columns."""
    cols = list(columns or numeric_columns(df))
    spark = df.sparkSession
    schema = "col_a string, col_b string, r double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    out = None
    for s in range(0, len(pairs), chunk):
        part = pairs[s:s + chunk]
        wide = df.agg(*[pearson(a, b).alias(f"p{k}") for k, (a, b) in enumerate(part)])
        stack = ", ".join(f"'{a}', '{b}', p{k}" for k, (a, b) in enumerate(part))
        long = wide.selectExpr(f"stack({len(part)}, {stack}) as (col_a, col_b, r)")
        out = long if out is None else out.unionByName(long)
    mirrored = out.where(F.col("col_a") != F.col("col_b")).select(
        F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    return out.unionByName(mirrored)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and % of all rows per class (null target not a class)."""
    tot = df.agg(F.count("*").alias("n_all"))
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(
        F.count("*").cast("bigint").alias("count"))
    return (g.crossJoin(F.broadcast(tot))
            .select("class", "count",
                    rnd(F.col("count") * 100.0 / F.col("n_all"), 2).alias("percentage"))
            .orderBy(F.desc("count"), "class"))


def near_constant(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Numerical with < 3 distinct or top value > 95 % of non-null rows;
    categorical with exactly one distinct value."""
    cols = [c for c in df.columns if kinds.get(c) in ("numerical", "categorical")]
    d = distinct_counts(df, cols)
    spark = df.sparkSession
    k = spark.createDataFrame([(c, kinds[c]) for c in cols], "column string, kind string")
    j = d.join(F.broadcast(k), "column")
    share = F.try_divide(F.col("top_count").cast("double"), F.col("non_null").cast("double"))
    num = F.col("kind") == "numerical"
    flag = ((num & ((F.col("n_unique") < NEAR_CONSTANT_MIN_UNIQUE) | (share > NEAR_CONSTANT_TOP_SHARE)))
            | (~num & (F.col("n_unique") == 1)))
    reason = (F.when(num & (F.col("n_unique") < NEAR_CONSTANT_MIN_UNIQUE), "few_unique")
              .when(num, "dominant_value").otherwise("single_value"))
    return j.where(flag).select("column", "kind", "n_unique",
                                rnd(share, 6).alias("top_share"), reason.alias("reason"))


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None,
                 factor: float = IQR_FACTOR, only_flagged: bool = True) -> DataFrame:
    """A10: values outside [Q1 − 1.5·IQR, Q3 + 1.5·IQR], count and % of
    non-null values; quartiles broadcast back as a columns-sized table."""
    cols = list(columns or numeric_columns(df))
    q = quantile_wide(df, cols, [0.25, 0.75], ["q1", "q3"])
    q = q.select("column", "q1", "q3",
                 (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("lower"),
                 (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("upper"))
    vc = value_counts(df, cols)
    j = vc.join(F.broadcast(q), "column")
    out = j.groupBy("column").agg(
        F.first("q1").alias("q1"), F.first("q3").alias("q3"),
        F.first("lower").alias("lower"), F.first("upper").alias("upper"),
        F.sum(F.when((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")),
                     F.col("n")).otherwise(0)).cast("bigint").alias("outlier_count"),
        F.sum("n").alias("n"))
    out = out.select("column", "q1", "q3", "lower", "upper", "outlier_count",
                     rnd(F.col("outlier_count") * 100.0 / F.col("n"), 2).alias("outlier_pct"))
    return out.where(F.col("outlier_count") > 0) if only_flagged else out


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max] per column, last bin closed;
    every bin present (zero counts included)."""
    cols = list(columns or numeric_columns(df))
    vc = value_counts(df, cols)
    st = vc.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = vc.join(F.broadcast(st), "column").withColumn("bin", hist_bin("value", "lo", "hi", bins))
    g = j.groupBy("column", "bin").agg(F.sum("n").cast("bigint").alias("count"))
    grid = st.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / float(bins)
    return (grid.join(g, ["column", "bin"], "left")
            .select("column", F.col("bin").cast("bigint").alias("bin"),
                    (F.col("bin") * step + F.col("lo")).alias("bin_lo"),
                    F.when(F.col("bin") == bins - 1, F.col("hi"))
                    .otherwise((F.col("bin") + 1) * step + F.col("lo")).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def box_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quartiles and 1.5·IQR whiskers (most extreme values inside)."""
    cols = list(columns or numeric_columns(df))
    q = quantile_wide(df, cols, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    vc = value_counts(df, cols)
    j = vc.join(F.broadcast(q), "column")
    lo_f = F.col("q1") - IQR_FACTOR * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + IQR_FACTOR * (F.col("q3") - F.col("q1"))
    return j.groupBy("column").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col("value") >= lo_f, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(F.col("value") <= hi_f, F.col("value"))).alias("upper_whisker"))


def top_categories(df: DataFrame, columns: Sequence[str], k: int = TOP_CATEGORIES) -> DataFrame:
    """K most frequent values per column, ties broken by value (a top-k
    report; the window runs over the distinct values of each column)."""
    g = _long_strings(df, columns).groupBy("column", "value").agg(F.count("*").cast("bigint").alias("count"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return (g.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= k))


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected sample skewness G1 = g1·√(n(n−1))/(n−2);
    0 for a constant column, null for n < 3; flag |G1| > 1."""
    cols = list(columns or numeric_columns(df))
    long = unpivot_numeric(df, cols)
    v = F.col("value")
    long = long.where(v.isNotNull() & ~F.isnan(v))
    g = long.groupBy("column").agg(F.count("*").alias("n"), F.skewness(v).alias("g1"),
                                   F.stddev_pop(v).alias("sd"))
    n = F.col("n").cast("double")
    g1 = F.when(F.col("n") < 3, F.lit(None)).when(F.col("sd") == 0, F.lit(0.0)) \
        .otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    return g.select("column", F.col("n").cast("bigint").alias("n"), g1.alias("skew"),
                    (F.abs(g1) > SKEW_FLAG).alias("is_skewed"))


def gram(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """N, Σx and Σx_i·x_j over complete rows (optionally per class) in
    long form (col_i, col_j, …) — the sufficient statistics of PCA, LDA,
    ridge, Mahalanobis.  One pass; the shuffle carries one partial row per
    partition and group."""
    cols = list(columns)
    keys = [by] if by else []
    complete = df.dropna(subset=cols)
    exprs = [F.count("*").alias("n")]
    exprs += [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    exprs += [F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(f"x{i}_{j}")
              for i, j in pairs]
    wide = complete.groupBy(*keys).agg(*exprs)
    stack = ", ".join(f"'{cols[i]}', '{cols[j]}', s{i}, s{j}, x{i}_{j}" for i, j in pairs)
    return wide.selectExpr(*keys, "n", f"stack({len(pairs)}, {stack}) as (col_i, col_j, sum_i, sum_j, sum_ij)")


def value_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Min, max and mean per numeric column (scoring-form defaults)."""
    cols = list(columns or numeric_columns(df))
    long = unpivot_numeric(df, cols)
    v = F.col("value")
    return long.where(v.isNotNull() & ~F.isnan(v)).groupBy("column").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))


def category_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct options per categorical column, long form with their
    sorted position (no per-column collect)."""
    d, n = sized(_long_strings(df, columns, val="option").distinct().withColumn("_one", F.lit(1)))
    return running_sums(d, ["column"], "option", ["_one"], n_rows=n).select(
        "column", "option", F.col("cum__one").cast("bigint").alias("position"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Reproducible fixed-size sample — the n rows with the smallest
    seeded hash of the key (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(hash_int(key, seed), F.col(key)).limit(n)


def missing_pattern(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """0/1 missing matrix of the P16 sample."""
    s = sample_rows(df, key, n, seed)
    return s.select(key, *[is_missing(df, c).cast("int").alias(c) for c in df.columns if c != key])


def page(df: DataFrame, key: str, page_no: int, size: int = PAGE_SIZE) -> DataFrame:
    """O1: rows of page ``page_no`` (0-based) in key order."""
    return df.orderBy(key).offset(page_no * size).limit(size)


def template_rows(df: DataFrame, features: Sequence[str], key: str, n: int = 3) -> DataFrame:
    """First rows of the feature columns (scoring template)."""
    return df.orderBy(key).select(*features).limit(n)
