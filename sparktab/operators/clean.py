"""Cleaning operators (P3-P11).  Statistics needed by a filter (medians,
variances, correlations) come from one aggregation job; the filter itself
is a projection."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clip, pearson, real
from .quantiles import fitted_quantiles

# Default thresholds of the reference filters.
LOW_VARIANCE = 0.01
HIGH_CORRELATION = 0.95


def drop_missing_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows null (or NaN) in any listed column."""
    if not columns:
        return df
    return df.na.drop(subset=list(columns))


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per distinct value of ``subset`` (all columns)."""
    return df.dropDuplicates(list(subset) if subset else None)


def low_variance_report(df: DataFrame, columns: Sequence[str],
                        threshold: float = LOW_VARIANCE) -> DataFrame:
    """P5: population variance after median fill; ``dropped`` when
    var <= threshold.  Also the preview's sample variance (``< threshold``)."""
    med = fitted_quantiles(df, columns, [0.5])
    exprs = []
    for c in columns:
        m = med[c][0]
        x = F.col(c).cast("double")
        filled = F.coalesce(F.when(~F.isnan(x), x), F.lit(m)) if m is not None else x
        exprs += [F.var_pop(filled).alias(f"vp_{c}"), F.var_samp(x).alias(f"vs_{c}")]
    wide = df.agg(*exprs)
    stack = ", ".join(f"'{c}', vp_{c}, vs_{c}" for c in columns)
    long = wide.selectExpr(f"stack({len(columns)}, {stack}) as (column, variance, sample_variance)")
    return long.select("column", "variance", "sample_variance",
                       F.coalesce(F.col("variance") <= threshold, F.lit(True)).alias("dropped"),
                       F.coalesce(F.col("sample_variance") < threshold, F.lit(False)).alias("preview_dropped"))


def low_variance_filter(df: DataFrame, columns: Sequence[str],
                        threshold: float = LOW_VARIANCE) -> DataFrame:
    drop = [r["column"] for r in low_variance_report(df, columns, threshold)
            .where("dropped").select("column").collect()]
    return df.drop(*drop)


def high_correlation_report(df: DataFrame, columns: Sequence[str],
                            threshold: float = HIGH_CORRELATION) -> DataFrame:
    """Column j is dropped when |r(i, j)| > threshold for some earlier
    column i (pairwise complete; the decision is not re-evaluated after
    drops).  One aggregation for all pairs."""
    cols = list(columns)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "column string, max_abs_corr double, dropped boolean")
    pairs = [(i, j) for j in range(len(cols)) for i in range(j)]
    wide = df.agg(*[pearson(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs])
    stack = ", ".join(f"'{cols[j]}', {j}, abs(r{i}_{j})" for i, j in pairs)
    long = wide.selectExpr(f"stack({len(pairs)}, {stack}) as (column, ordinal, r)")
    g = long.groupBy("column").agg(F.max("r").alias("max_abs_corr"),
                                   F.max(F.coalesce(F.col("r") > threshold, F.lit(False))).alias("dropped"))
    first = spark.createDataFrame([(cols[0], None, False)], "column string, max_abs_corr double, dropped boolean")
    return first.unionByName(g)


def high_correlation_filter(df: DataFrame, columns: Sequence[str],
                            threshold: float = HIGH_CORRELATION) -> DataFrame:
    drop = [r["column"] for r in high_correlation_report(df, columns, threshold)
            .where("dropped").select("column").collect()]
    return df.drop(*drop)


def out_of_range_count(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Out-of-range values per enabled column and in total; NaN is in no range and out of none."""
    exprs = [F.count_if((real(c) < lo) | (real(c) > hi)).cast("bigint").alias(c)
             for c, (lo, hi) in ranges.items()]
    wide = df.agg(*exprs)
    stack = ", ".join(f"'{c}', `{c}`" for c in ranges)
    return wide.selectExpr(f"stack({len(ranges)}, {stack}) as (column, out_of_range)")


def clip_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip to [lo, hi]; null stays null and NaN NaN."""
    return df.select(*[clip(c, *ranges[c]).alias(c) if c in ranges else F.col(c)
                       for c in df.columns])


def regex_mask(c: str, pattern: str):
    """True where the value does NOT match ``pattern`` from its start;
    a null is tested as the text 'nan' (the reference's string cast)."""
    return ~F.coalesce(F.col(c).cast("string"), F.lit("nan")).rlike(f"^(?:{pattern})")


def regex_validate(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Non-matching values become null."""
    return df.select(*[F.when(regex_mask(c, patterns[c]), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in patterns else F.col(c) for c in df.columns])


def regex_report(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    wide = df.agg(*[F.count_if(regex_mask(c, p)).cast("bigint").alias(c) for c, p in patterns.items()])
    stack = ", ".join(f"'{c}', `{c}`" for c in patterns)
    return wide.selectExpr(f"stack({len(patterns)}, {stack}) as (column, non_matching)")


def validate_rows(df: DataFrame, numeric: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Per-row ``errors`` array — numeric columns must cast to double,
    ``required`` columns (imputation = drop) must be present.  Split good
    rows from the quarantine with ``size(errors) = 0``."""
    errs = []
    for c in numeric:
        x = F.col(c)
        if isinstance(df.schema[c].dataType, T.StringType):
            bad = x.isNotNull() & x.try_cast("double").isNull()
            errs.append(F.when(bad, F.lit(f"{c}: not a number")))
    for c in required:
        errs.append(F.when(F.col(c).isNull(), F.lit(f"{c}: missing value")))
    arr = F.array_compact(F.array(*errs)) if errs else F.array().cast("array<string>")
    return df.withColumn("errors", arr)
