"""Deterministic pseudo-predictions derived from the driver tables (FIXTURES
§2): seeded hash keys give the same values on Spark and DuckDB, so metrics
can be checked without a fitted model.  Every fixture reads whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import hash_int, hash_unit
from ..sources.tables import table

CLASSES = ["A", "N", "R"]


def LI_KEY():  # noqa: N802
    """Unique lineitem row key (order, line, part, supplier) as text; the
    DuckDB twin is concat_ws('-', …) of the same columns."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _hsql(k: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({k} AS VARCHAR)), 1, 8))::BIGINT"


def _usql(k: str, seed: int) -> str:
    return f"({_hsql(k, seed)} / CAST(4294967296.0 AS DOUBLE))"


def li_keyed(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("k", LI_KEY())


def multiclass_preds(spark, sf):
    li = li_keyed(spark, sf)
    h, u = hash_int("k", 42), hash_unit("k", 7)
    y = F.col("l_returnflag")
    pred = F.when(h % 100 < 80, y).otherwise(F.element_at(F.array(*[F.lit(c) for c in CLASSES]),
                                                          (h % 3 + 1).cast("int")))
    x = li.select("k", y.alias("y"), pred.alias("pred"), u.alias("u"),
                  *[hash_unit("k", 11 + i).alias(f"v_{c}") for i, c in enumerate(CLASSES)])
    raws = {c: F.when(F.col("pred") == c, 1.0 + F.col("u")).otherwise(F.col(f"v_{c}")) for c in CLASSES}
    total = raws["A"] + raws["N"] + raws["R"]
    return x.select("k", "y", "pred", *[(raws[c] / total).alias(f"p_{c}") for c in CLASSES])


MULTICLASS_SQL = f"""mc AS (SELECT k, y, pred, {', '.join(f"raw_{c} / (raw_A + raw_N + raw_R) AS p_{c}" for c in CLASSES)} FROM
  (SELECT k, y, pred, {', '.join(f"CASE WHEN pred = '{c}' THEN 1.0 + u ELSE {_usql('k', 11 + i)} END AS raw_{c}" for i, c in enumerate(CLASSES))} FROM
    (SELECT k, l_returnflag AS y, CASE WHEN {_hsql('k', 42)} % 100 < 80 THEN l_returnflag
       ELSE ['A', 'N', 'R'][{_hsql('k', 42)} % 3 + 1] END AS pred, {_usql('k', 7)} AS u
     FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem))))"""


def binary_preds(spark, sf):
    li = li_keyed(spark, sf)
    y = (F.col("l_returnflag") == "R").cast("int")
    score = F.floor((F.lit(0.35) * y + F.lit(0.65) * hash_unit("k", 7)) * 1000) / 1000
    x = li.select("k", y.alias("y"), score.alias("score"))
    return x.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


BINARY_SQL = f"""bp AS (SELECT k, y, score, CAST(score >= 0.5 AS INT) AS pred FROM
  (SELECT k, y, floor((CAST(0.35 AS DOUBLE) * y + CAST(0.65 AS DOUBLE) * {_usql('k', 7)}) * 1000) / 1000 AS score FROM
    (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)))"""


def regression_preds(spark, sf):
    li = li_keyed(spark, sf)
    return li.select("k", F.col("l_extendedprice").alias("y"),
                     (F.col("l_extendedprice") * (F.lit(0.9) + F.lit(0.2) * hash_unit("k", 7))).alias("p"))


REGRESSION_SQL = f"""rp AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, l_extendedprice AS y,
  l_extendedprice * (CAST(0.9 AS DOUBLE) + CAST(0.2 AS DOUBLE) * {_usql("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", 7)}) AS p FROM lineitem)"""


def embedding_clusters(spark, sf):
    e = table(spark, sf, "embeddings")
    lab = F.when(hash_int("vec_id", 42) % 10 == 0, F.lit(-1)).otherwise(F.col("label"))
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), lab.alias("label"))


EMBED_SQL = f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x,
  CASE WHEN {_hsql('vec_id', 42)} % 10 = 0 THEN -1 ELSE label END AS lab FROM embeddings)"""


def vector_dim(df, col: str) -> int:
    r = df.select(F.size(col).alias("d")).where("d > 0").first()
    return int(r["d"]) if r else 0
