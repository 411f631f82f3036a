"""Exact, distributed quantiles with linear interpolation.

Spark's ``percentile`` keeps a value→count map per group in one aggregation
buffer; at scale that buffer is the whole distinct domain of a column in one
task.  Here the values are pre-aggregated to (column, value, count) with a
shuffle, ranked with bucketed running sums (:mod:`.running`), and the two
order statistics around each target position are picked by a broadcast
range join against the tiny (column, p) target table.  The result equals
``percentile`` / DuckDB ``quantile_cont``: q = v[lo] + (v[hi] − v[lo])·frac,
pos = p·(n − 1)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import unpivot_numeric
from .running import running_sums, sized


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) over non-null, non-NaN values of every column."""
    long = unpivot_numeric(df, columns)
    v = F.col("value")
    return (long.where(v.isNotNull() & ~F.isnan(v))
            .groupBy("column", "value").agg(F.count("*").alias("n")))


def quantiles_from_counts(counts: DataFrame, probs: Sequence[float],
                          group: Sequence[str] = ("column",)) -> DataFrame:
    """(group…, p, q) from a (group…, value, n) table."""
    group = list(group)
    counts, n_rows = sized(counts)
    cum = running_sums(counts, group, "value", ["n"], n_rows=n_rows)
    totals = counts.groupBy(*group).agg(F.sum("n").alias("N"))
    spark = counts.sparkSession
    ps = spark.createDataFrame([(float(p),) for p in probs], "p double")
    targets = totals.crossJoin(ps).select(
        *group, "p", (F.col("p") * (F.col("N") - 1)).alias("pos"))
    targets = targets.select(*group, "p", "pos",
                             F.floor("pos").cast("bigint").alias("r_lo"),
                             F.ceil("pos").cast("bigint").alias("r_hi"))
    # value at 0-based rank r: cum_n - n <= r <= cum_n - 1
    c = cum.select(*group, "value", (F.col("cum_n") - F.col("n")).alias("first"),
                   (F.col("cum_n") - 1).alias("last"))
    t = F.broadcast(targets.alias("t"))
    cond = [F.col(f"c.{g}") == F.col(f"t.{g}") for g in group]
    lo = (c.alias("c").join(t, cond + [F.col("c.first") <= F.col("t.r_lo"),
                                        F.col("t.r_lo") <= F.col("c.last")])
          .select(*[F.col(f"t.{g}").alias(g) for g in group], F.col("t.p").alias("p"),
                  F.col("t.pos").alias("pos"), F.col("t.r_lo").alias("r_lo"),
                  F.col("c.value").alias("v_lo")))
    hi = (c.alias("c").join(t, cond + [F.col("c.first") <= F.col("t.r_hi"),
                                        F.col("t.r_hi") <= F.col("c.last")])
          .select(*[F.col(f"t.{g}").alias(g) for g in group], F.col("t.p").alias("p"),
                  F.col("c.value").alias("v_hi")))
    j = lo.join(hi, group + ["p"])
    q = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("pos") - F.col("r_lo"))
    return j.select(*group, "p", q.alias("q"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, p, q) for every numeric column and probability."""
    return quantiles_from_counts(value_counts(df, columns), probs)


def quantile_wide(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                  names: Sequence[str]) -> DataFrame:
    """One row per column with one field per probability (``names``)."""
    q = exact_quantiles(df, columns, probs)
    return (q.groupBy("column")
            .pivot("p", [float(p) for p in probs]).agg(F.first("q"))
            .toDF("column", *names))


def fitted_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    """Driver-side {column: [q…]} — a fit statistic of columns × probs values."""
    rows = exact_quantiles(df, columns, probs).collect()
    out = {c: [None] * len(probs) for c in columns}
    idx = {float(p): i for i, p in enumerate(probs)}
    for r in rows:
        out[r["column"]][idx[r["p"]]] = r["q"]
    return out
