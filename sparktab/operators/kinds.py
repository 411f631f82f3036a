"""Column-kind and task inference.

Kinds: numeric and boolean types → ``numerical``; date/timestamp types →
``datetime``; strings → ``datetime`` when every non-null value parses with
one of the accepted patterns (an all-null column therefore counts as
datetime), else ``categorical`` when n_unique <= 20 or n_unique/n_rows <
0.05, else ``text``; any other type → ``text``.  Distinct counts are exact,
computed on the unpivoted (column, value) table so that many columns cost
one shuffle of distinct values instead of one Expand copy per column."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import unpivot_string

# Categorical cut-offs of the kind rules.
MAX_CATEGORIES = 20
MAX_CARDINALITY_RATIO = 0.05

# Accepted text timestamp layouts (Spark pattern, DuckDB strptime twin).
DATETIME_PATTERNS = [
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType, T.BooleanType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def parse_timestamp(c) -> Column:
    """First accepted layout that parses, else null (never raises)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(p)) for p, _ in DATETIME_PATTERNS])


def static_kind(dtype: T.DataType) -> str | None:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numerical"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return None
    return "text"


def detect_kinds(df: DataFrame) -> DataFrame:
    """P1 → (column, kind, n_unique, n_rows); n_unique only for strings."""
    spark = df.sparkSession
    fields = df.schema.fields
    strings = [f.name for f in fields if static_kind(f.dataType) is None]
    rows = [(i, f.name, static_kind(f.dataType)) for i, f in enumerate(fields)]
    base = spark.createDataFrame(rows, "ordinal int, column string, static_kind string")
    n_rows = df.agg(F.count("*").cast("bigint").alias("n_rows"))
    if strings:
        distinct = (unpivot_string(df, strings).where(F.col("value").isNotNull())
                    .select("column", "value").distinct())
        per_col = distinct.groupBy("column").agg(
            F.count("*").cast("bigint").alias("n_unique"),
            F.count_if(parse_timestamp("value").isNull()).cast("bigint").alias("n_unparsed"))
        base = base.join(per_col, "column", "left")
    else:
        base = base.withColumn("n_unique", F.lit(None).cast("bigint")) \
                   .withColumn("n_unparsed", F.lit(None).cast("bigint"))
    j = base.crossJoin(F.broadcast(n_rows))
    is_str = F.col("static_kind").isNull()
    nu = F.coalesce(F.col("n_unique"), F.lit(0))
    kind = (F.when(~is_str, F.col("static_kind"))
            .when(F.coalesce(F.col("n_unparsed"), F.lit(0)) == 0, "datetime")
            .when((nu <= MAX_CATEGORIES)
                  | ((F.col("n_rows") > 0) & (nu / F.col("n_rows") < MAX_CARDINALITY_RATIO)),
                  "categorical")
            .otherwise("text"))
    return j.select("ordinal", "column", kind.alias("kind"),
                    F.when(is_str, nu).alias("n_unique"), "n_rows").orderBy("ordinal").drop("ordinal")


def kinds_map(df: DataFrame) -> dict[str, str]:
    """Collect the (tiny, one row per column) kinds table as a dict."""
    return {r["column"]: r["kind"] for r in detect_kinds(df).collect()}


def detect_task(df: DataFrame, target: str | None) -> DataFrame:
    """No target → clustering; exactly 2 distinct → binary; strings →
    multiclass; numeric with <= 20 distinct → multiclass; else regression."""
    spark = df.sparkSession
    if not target or target not in df.columns:
        return spark.createDataFrame([(target, None, None, "clustering")],
                                     "target string, n_unique bigint, is_numeric boolean, task string")
    numeric = isinstance(df.schema[target].dataType, NUMERIC_TYPES)
    nu = (df.where(F.col(target).isNotNull()).select(target).distinct()
          .agg(F.count("*").cast("bigint").alias("n_unique")))
    task = (F.when(F.col("n_unique") == 2, "binary_classification")
            .when(~F.col("is_numeric"), "multiclass_classification")
            .when(F.col("n_unique") <= MAX_CATEGORIES, "multiclass_classification")
            .otherwise("regression"))
    return nu.select(F.lit(target).alias("target"), "n_unique",
                     F.lit(numeric).alias("is_numeric")).select("*", task.alias("task"))
