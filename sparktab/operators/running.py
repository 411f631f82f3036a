"""GSUM: running sums over an ordered key without a single-partition window.

``Window.partitionBy(g).orderBy(v)`` sends every row of a group to one task.
Here rows are range-partitioned on (group, order) into parts of a bounded
number of rows, written once so that the parts stay what they are, and summed
inside each part; the totals of a group's parts become offsets.  There is one
plan for every size.  Rows must already be unique per (group, order key)."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions, written

#: Rows of one part, and so of one window task, on average.
ROWS_PER_PART = 200_000


def sized(df: DataFrame) -> tuple[DataFrame, int]:
    """Write an intermediate that is read several times and count it."""
    table = written(df, "intermediate")
    return table, table.count()


def same_keys(left: str, right: str, keys: Sequence[str]):
    """Join condition that also matches null keys."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def running_sums(df: DataFrame, group: Sequence[str], order, sums: Sequence[str],
                 descending: bool = False, prefix: str = "cum_", n_rows: int | None = None,
                 rows_per_part: int = ROWS_PER_PART, buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` per ``group`` in ``order`` (one column
    or several, the later ones to break ties).  ``n_rows`` is the number of
    rows where the caller knows it; ``buckets`` sets the number of parts."""
    group = list(group)
    orders = [order] if isinstance(order, str) else list(order)
    ordered = [F.col(o).desc() if descending else F.col(o).asc() for o in orders]
    parts = buckets or -(-(df.count() if n_rows is None else n_rows) // rows_per_part) or 1
    dealt = written(df.repartitionByRange(parts, *group, *ordered)
                    .withColumn("_part", F.spark_partition_id()), "range-parts")
    keys = [*group, "_part"]
    totals = dealt.groupBy(*keys).agg(*[F.sum(s).alias("_tot_" + s) for s in sums])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum("_tot_" + s).over(before), F.lit(0)).alias("_off_" + s)
                                     for s in sums])
    inside = Window.partitionBy(*keys).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # where Spark would make fewer tasks than there are parts, a task's rows would grow with the table
    rows = dealt.repartition(parts, *keys) if parts > shuffle_partitions(df.sparkSession) else dealt
    inner = rows.select("*", *[F.sum(s).over(inside).alias("_in_" + s) for s in sums])
    out = inner.alias("i").join(offsets.alias("o"), same_keys("i", "o", keys))
    return out.select(*[F.col(f"i.{c}").alias(c) for c in df.columns], *[
        (F.col("i._in_" + s) + F.col("o._off_" + s)).alias(prefix + s) for s in sums])
