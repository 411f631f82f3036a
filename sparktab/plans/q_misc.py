"""Sources, set operations, recipes and KNN imputation."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import round_all
from ..operators import kinds as K
from ..operators import prep as PR
from ..operators import split as S
from ..operators.impute_knn import knn_impute as knn_impute_rows
from ..session import scratch_path
from ..sources.tables import load_dataset, table
from .registry import query


def _events_files(spark, sf, fmt):
    path = scratch_path(spark, f"events-{fmt}-{uuid.uuid4().hex[:8]}") + f".{fmt}"
    ev = table(spark, sf, "events")
    (ev.write.option("header", "true").csv(path) if fmt == "csv" else ev.write.json(path))
    return ev, path


@query("scan_csv", """SELECT CAST(count(*) AS BIGINT) AS "rows", round(sum(value), 6) AS value_sum,
  CAST(count(DISTINCT event_type) AS BIGINT) AS n_types FROM events""")
def scan_csv(spark, sf):
    ev, path = _events_files(spark, sf, "csv")
    df = load_dataset(spark, path, schema=ev.schema)
    return round_all(df.agg(F.count("*").cast("bigint").alias("rows"), F.sum("value").alias("value_sum"),
                            F.count_distinct("event_type").cast("bigint").alias("n_types")), 6)


@query("scan_json_props", """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1""")
def scan_json_props(spark, sf):
    ev = table(spark, sf, "events")
    path = scratch_path(spark, f"props-{uuid.uuid4().hex[:8]}") + ".json"
    ev.select("props").write.text(path)          # one JSON document per line
    props = load_dataset(spark, path, schema="k bigint")
    return props.groupBy("k").agg(F.count("*").cast("bigint").alias("n"))


@query("union_train_val", """SELECT CAST(count(*) - ceil(CAST(0.2 AS DECIMAL(20,9)) * count(*)) AS BIGINT) AS "rows" FROM orders""")
def union_train_val(spark, sf):
    """Train ∪ val by name."""
    s = S.assign_split(table(spark, sf, "orders"), "o_orderkey")
    u = s.where("split = 'train'").unionByName(s.where("split = 'val'"))
    return u.agg(F.count("*").cast("bigint").alias("rows"))


@query("observed_categories", """SELECT DISTINCT o_orderpriority AS category FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'
UNION SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'""")
def observed_categories(spark, sf):
    """Union of categories seen on either side."""
    o = table(spark, sf, "orders")
    cut = F.lit("1995-01-01").cast("timestamp_ntz")
    a = o.where(F.col("o_orderdate") < cut).select(F.col("o_orderpriority").alias("category"))
    b = o.where(F.col("o_orderdate") >= cut).select(F.col("o_orderpriority").alias("category"))
    return a.union(b).distinct()


@query("unseen_categories", """SELECT DISTINCT o_orderpriority AS category FROM orders
WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'F')""")
def unseen_categories(spark, sf):
    """Categories of the current side absent from the reference (anti join)."""
    o = table(spark, sf, "orders")
    ref = o.where((F.col("o_orderpriority") != "5-LOW") & (F.col("o_orderstatus") == "F"))
    cur = o.select(F.col("o_orderpriority").alias("category")).distinct()
    return cur.join(ref.select(F.col("o_orderpriority").alias("category")).distinct(), "category", "left_anti")


def _orders_features(spark, sf):
    from .q_profile import orders_nulls
    return S.assign_split(orders_nulls(spark, sf), "o_orderkey")


@query("auto_preprocess")
def auto_preprocess(spark, sf):
    """P12-P14 + S6: kinds → default recipe → fit on train → transform all."""
    df = _orders_features(spark, sf).drop("bad_num")
    kinds = K.kinds_map(df.drop("split", "o_orderkey"))
    rec = PR.smart_defaults(kinds, target="o_orderstatus")
    pre = PR.Preprocessor(rec, target="o_orderstatus").fit(df.where("split = 'train'"))
    out = pre.transform(df, keep=["o_orderkey", "split"])
    meta = pre.to_json()
    return round_all(out.groupBy("split").agg(F.count("*").alias("rows"),
                                               *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(pre.output_names())])
                     .withColumn("n_features", F.lit(len(pre.output_names())))
                     .withColumn("schema_bytes", F.lit(len(meta))), 6)


@query("preprocessing_summary")
def preprocessing_summary(spark, sf):
    """Kept / dropped columns, features after encoding, rows per split."""
    df = _orders_features(spark, sf).drop("bad_num")
    kinds = K.kinds_map(df.drop("split", "o_orderkey"))
    rec = PR.smart_defaults(kinds, target="o_orderstatus")
    pre = PR.Preprocessor(rec, target="o_orderstatus").fit(df.where("split = 'train'"))
    kept = len(pre.feature_columns)
    return (S.split_sizes(df).withColumn("kept_columns", F.lit(kept))
            .withColumn("dropped_columns", F.lit(len(rec) - kept))
            .withColumn("features_after", F.lit(len(pre.output_names()))))


@query("knn_impute", """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS a,
  CAST(c_nationkey AS DOUBLE) AS n FROM customer),
q AS (SELECT * FROM c WHERE a IS NULL),
d AS (SELECT q.id AS qid, c.id AS rid, c.a AS val, sqrt(2.0 / 1 * (q.n - c.n) * (q.n - c.n)) AS dist FROM q, c WHERE c.a IS NOT NULL),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM d) WHERE rk <= 5),
f AS (SELECT qid, avg(val) AS fill FROM nn GROUP BY qid)
SELECT id AS c_custkey, round(coalesce(a, fill), 6) AS acct, round(n, 6) AS nation FROM c LEFT JOIN f ON f.qid = c.id""")
def knn_impute(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("acct"),
        F.col("c_nationkey").cast("double").alias("nation"))
    return round_all(knn_impute_rows(c, ["acct", "nation"], "c_custkey", 5), 6)
