"""Profiling queries: orders with injected nulls (FIXTURES §2), lineitem,
part.  Doubles are rounded to 6 dp on both engines."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd, round_all
from ..operators import kinds as K
from ..operators import profile as P
from ..sources.tables import table
from .registry import query
from .sqlgen import ORDERS_N, ORDERS_N_COLS, ORDERS_N_NUM, hash_order, kinds_sql, long_numeric

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLOATING = {"o_totalprice", "price_n", "const_one"}


def orders_nulls(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).cast("double").alias("price_n"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("priority_n"),
        F.lit(1.0).alias("const_one"),
        F.when(k % 13 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("bad_num"))


def _flag(c):
    return f"({c} IS NULL OR isnan({c}))" if c in FLOATING else f"({c} IS NULL)"


_ON_COLS = [c for c, _ in ORDERS_N_COLS]
_MISSING_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({_flag(c)} AS INT) AS m FROM orders_n" for c in _ON_COLS)


@query("kinds_orders", f"WITH {ORDERS_N} {kinds_sql('orders_n', ORDERS_N_COLS)}")
def kinds_orders(spark, sf):
    return K.detect_kinds(orders_nulls(spark, sf))


@query("task_type_orderstatus", """SELECT 'o_orderstatus' AS target, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_unique,
  false AS is_numeric, CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binary_classification'
  ELSE 'multiclass_classification' END AS task FROM orders""")
def task_orderstatus(spark, sf):
    return K.detect_task(table(spark, sf, "orders"), "o_orderstatus")


@query("task_type_retailprice", """SELECT 'p_retailprice' AS target, CAST(count(DISTINCT p_retailprice) AS BIGINT) AS n_unique,
  true AS is_numeric, CASE WHEN count(DISTINCT p_retailprice) = 2 THEN 'binary_classification'
  WHEN count(DISTINCT p_retailprice) <= 20 THEN 'multiclass_classification' ELSE 'regression' END AS task
  FROM part""")
def task_retailprice(spark, sf):
    return K.detect_task(table(spark, sf, "part"), "p_retailprice")


_TOTAL_MISSING = " + ".join(f"CAST({_flag(c)} AS INT)" for c in _ON_COLS)


@query("dataset_summary", f"""WITH {ORDERS_N}, k AS ({kinds_sql('orders_n', ORDERS_N_COLS)}),
s AS (SELECT count(*) AS n, sum({_TOTAL_MISSING}) AS miss FROM orders_n),
d AS (SELECT count(*) AS g FROM (SELECT DISTINCT * FROM orders_n))
SELECT CAST(n AS BIGINT) AS "rows", CAST({len(_ON_COLS)} AS BIGINT) AS "columns",
  CAST(miss AS BIGINT) AS total_missing,
  CASE WHEN n > 0 THEN round(miss * 100.0 / (n * {len(_ON_COLS)}), 2) ELSE 0.0 END AS missing_percentage,
  CAST(n - g AS BIGINT) AS duplicate_rows,
  (SELECT CAST(count(*) FILTER (WHERE kind = 'numerical') AS BIGINT) FROM k) AS n_numerical,
  (SELECT CAST(count(*) FILTER (WHERE kind = 'categorical') AS BIGINT) FROM k) AS n_categorical,
  (SELECT CAST(count(*) FILTER (WHERE kind = 'datetime') AS BIGINT) FROM k) AS n_datetime,
  (SELECT CAST(count(*) FILTER (WHERE kind = 'text') AS BIGINT) FROM k) AS n_text
FROM s, d""")
def dataset_summary(spark, sf):
    return P.dataset_summary(orders_nulls(spark, sf))


@query("missing_values", f"""WITH {ORDERS_N}
SELECT "column", CAST(sum(m) AS BIGINT) AS missing_count,
  coalesce(round(sum(m) * 100.0 / count(*), 2), 0.0) AS missing_percentage
FROM ({_MISSING_LONG}) GROUP BY "column" """)
def missing_values(spark, sf):
    return P.missing_values(orders_nulls(spark, sf))


@query("missing_report", f"""WITH {ORDERS_N}, g AS (SELECT "column", avg(m) AS ratio FROM ({_MISSING_LONG})
  GROUP BY "column" HAVING avg(m) > 0)
SELECT "column", round(ratio, 6) AS missing_ratio,
  CASE WHEN ratio > 0.2 THEN 'high' WHEN ratio > 0.05 THEN 'medium' ELSE 'low' END AS severity,
  (SELECT CAST(count(*) FILTER (WHERE ratio > 0.2) AS BIGINT) FROM g) AS n_high_columns
FROM g""")
def missing_report(spark, sf):
    return P.missing_report(orders_nulls(spark, sf))


_CARD_PARTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) FILTER (WHERE NOT {_flag(c)}) AS BIGINT) AS non_null,
  CAST(count(DISTINCT CASE WHEN NOT {_flag(c)} THEN {c} END) AS BIGINT) AS n_unique FROM orders_n"""
    for c in _ON_COLS)


@query("column_cards", f"""WITH {ORDERS_N}, k AS ({kinds_sql('orders_n', ORDERS_N_COLS)})
SELECT c."column", k.kind, c.non_null, c.n_unique FROM ({_CARD_PARTS}) c JOIN k USING ("column")""")
def column_cards(spark, sf):
    return P.column_cards(orders_nulls(spark, sf))


_DESCRIBE_PARTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS "count", round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS "min",
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS "max"
  FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM orders_n WHERE {c} IS NOT NULL AND NOT isnan({c}))"""
    for c in ORDERS_N_NUM)


@query("describe_numeric", f"WITH {ORDERS_N} {_DESCRIBE_PARTS}")
def describe_numeric(spark, sf):
    return round_all(P.describe(orders_nulls(spark, sf), ORDERS_N_NUM), 6)


CORR_COLS = ["o_totalprice", "price_n", "const_one", "o_custkey"]


def _corr_sql():
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            m = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            xa, xb = f"CASE WHEN {m} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {m} THEN CAST({b} AS DOUBLE) END"
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b,
  round(covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0), 6) AS r FROM orders_n""")
    return f"WITH {ORDERS_N} " + " UNION ALL ".join(parts)


@query("correlation", _corr_sql())
def correlation(spark, sf):
    return round_all(P.correlation(orders_nulls(spark, sf), CORR_COLS), 6)


@query("class_balance", f"""WITH {ORDERS_N}
SELECT priority_n AS class, CAST(count(*) AS BIGINT) AS "count",
  round(count(*) * 100.0 / (SELECT count(*) FROM orders_n), 2) AS percentage
FROM orders_n WHERE priority_n IS NOT NULL GROUP BY priority_n""")
def class_balance(spark, sf):
    return P.class_balance(orders_nulls(spark, sf), "priority_n")


@query("duplicate_rows", """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM
  (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity)""")
def duplicate_rows(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return P.duplicate_rows(li)


def _near_const_sql():
    parts = []
    for c, k in ORDERS_N_COLS:
        parts.append(f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_unique,
  CAST(sum(n) AS DOUBLE) AS nn, CAST(max(n) AS DOUBLE) AS top FROM
  (SELECT {c} AS v, count(*) AS n FROM orders_n WHERE NOT {_flag(c)} GROUP BY {c})""")
    return f"""WITH {ORDERS_N}, k AS ({kinds_sql('orders_n', ORDERS_N_COLS)}),
d AS ({' UNION ALL '.join(parts)})
SELECT d."column", k.kind, d.n_unique, round(top / nn, 6) AS top_share,
  CASE WHEN k.kind = 'numerical' AND d.n_unique < 3 THEN 'few_unique'
       WHEN k.kind = 'numerical' THEN 'dominant_value' ELSE 'single_value' END AS reason
FROM d JOIN k USING ("column")
WHERE (k.kind = 'numerical' AND (d.n_unique < 3 OR top / nn > 0.95))
   OR (k.kind = 'categorical' AND d.n_unique = 1)"""


@query("near_constant", _near_const_sql())
def near_constant(spark, sf):
    df = orders_nulls(spark, sf)
    return P.near_constant(df, K.kinds_map(df))


def _iqr_sql():
    parts = []
    for c in LI_NUM:
        parts.append(f"""SELECT '{c}' AS "column", q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
  (SELECT count(*) FROM lineitem WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS oc,
  (SELECT count({c}) FROM lineitem) AS n
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""")
    return f"""SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower,
  round(hi, 6) AS upper, CAST(oc AS BIGINT) AS outlier_count, round(oc * 100.0 / n, 2) AS outlier_pct
FROM ({' UNION ALL '.join(parts)})"""


@query("iqr_outliers", _iqr_sql())
def iqr_outliers(spark, sf):
    return round_all(P.iqr_outliers(table(spark, sf, "lineitem"), LI_NUM, only_flagged=False), 6)


HIST_COLS = ["l_extendedprice", "l_quantity"]
HIST_BINS = 20


def _hist_sql():
    b = " + ".join(f"(CASE WHEN value >= {float(i)} * ((hi - lo) / {float(HIST_BINS)}) + lo THEN 1 ELSE 0 END)"
                   for i in range(1, HIST_BINS))
    return f"""WITH v AS ({long_numeric('lineitem', HIST_COLS)}),
st AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM v GROUP BY "column"),
b AS (SELECT v."column", {b} AS bin FROM v JOIN st USING ("column")),
g AS (SELECT "column", bin, count(*) AS n FROM b GROUP BY "column", bin),
grid AS (SELECT "column", lo, hi, r.bin FROM st, range(0, {HIST_BINS}) r(bin))
SELECT grid."column", CAST(grid.bin AS BIGINT) AS bin,
  round(grid.bin * ((hi - lo) / {float(HIST_BINS)}) + lo, 6) AS bin_lo,
  round(CASE WHEN grid.bin = {HIST_BINS - 1} THEN hi ELSE (grid.bin + 1) * ((hi - lo) / {float(HIST_BINS)}) + lo END, 6) AS bin_hi,
  CAST(coalesce(g.n, 0) AS BIGINT) AS "count"
FROM grid LEFT JOIN g ON grid."column" = g."column" AND grid.bin = g.bin"""


@query("histogram", _hist_sql())
def histogram(spark, sf):
    return round_all(P.histogram(table(spark, sf, "lineitem"), HIST_COLS, HIST_BINS), 6)


def _box_sql():
    parts = []
    for c in LI_NUM:
        parts.append(f"""SELECT '{c}' AS "column", q1, med, q3,
  (SELECT min({c}) FROM lineitem WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS lw,
  (SELECT max({c}) FROM lineitem WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS uw
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
        quantile_cont({c}, 0.75) AS q3 FROM lineitem)""")
    return f"""SELECT "column", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(lw, 6) AS lower_whisker, round(uw, 6) AS upper_whisker FROM ({' UNION ALL '.join(parts)})"""


@query("box_stats", _box_sql())
def box_stats(spark, sf):
    return round_all(P.box_stats(table(spark, sf, "lineitem"), LI_NUM), 6)


@query("top_categories", """WITH l AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part
  UNION ALL SELECT 'p_type', p_type FROM part),
g AS (SELECT "column", value, count(*) AS "count" FROM l WHERE value IS NOT NULL GROUP BY "column", value)
SELECT "column", value, CAST("count" AS BIGINT) AS "count", CAST(rk AS BIGINT) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS rk FROM g)
WHERE rk <= 20""")
def top_categories(spark, sf):
    return P.top_categories(table(spark, sf, "part"), ["p_brand", "p_type"], 20)


def _skew_sql():
    parts = []
    for c in LI_NUM:
        parts.append(f"""SELECT '{c}' AS "column", n, sd, m3 / pow(m2, 1.5) AS g1 FROM
  (SELECT count(*) AS n, stddev_pop(x) AS sd, avg((x - mu) * (x - mu)) AS m2,
          avg((x - mu) * (x - mu) * (x - mu)) AS m3
   FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS mu FROM lineitem WHERE {c} IS NOT NULL))""")
    return f"""SELECT "column", CAST(n AS BIGINT) AS n, round(sk, 6) AS skew, abs(sk) > 1.0 AS is_skewed FROM
  (SELECT *, CASE WHEN n < 3 THEN NULL WHEN sd = 0 THEN 0.0
     ELSE g1 * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) END AS sk FROM ({' UNION ALL '.join(parts)}))"""


@query("skewness", _skew_sql())
def skewness(spark, sf):
    return round_all(P.skewness(table(spark, sf, "lineitem"), LI_NUM), 6)


GRAM_COLS = ["l_quantity", "l_discount", "l_tax"]


def _gram_sql():
    parts = []
    for i, a in enumerate(GRAM_COLS):
        for b in GRAM_COLS[i:]:
            parts.append(f"""SELECT '{a}' AS col_i, '{b}' AS col_j, CAST(count(*) AS BIGINT) AS n,
  round(sum({a}), 4) AS sum_i, round(sum({b}), 4) AS sum_j, round(sum({a} * {b}), 4) AS sum_ij FROM lineitem""")
    return " UNION ALL ".join(parts)


@query("gram", _gram_sql())
def gram(spark, sf):
    g = P.gram(table(spark, sf, "lineitem"), GRAM_COLS)
    return round_all(g, 4).withColumn("n", F.col("n").cast("bigint"))


@query("value_ranges", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(min({c}), 6) AS "min", round(max({c}), 6) AS "max",
  round(avg({c}), 4) AS mean FROM lineitem""" for c in LI_NUM))
def value_ranges(spark, sf):
    # the l_discount mean is an exact 7-digit decimal: at 6 digits it sits on a
    # rounding tie, and the answer would depend on the order of the sum
    r = P.value_ranges(table(spark, sf, "lineitem"), LI_NUM)
    return round_all(r.withColumn("mean", rnd("mean", 4)), 6)


@query("category_options", """SELECT "column", option, CAST(row_number() OVER (PARTITION BY "column" ORDER BY option) AS BIGINT) AS position
FROM (SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS option FROM orders
      UNION SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders)""")
def category_options(spark, sf):
    return P.category_options(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("sample_rows", f"""SELECT * FROM orders ORDER BY {hash_order('o_orderkey')}, o_orderkey LIMIT 100""")
def sample_rows(spark, sf):
    return P.sample_rows(table(spark, sf, "orders"), "o_orderkey", 100)


@query("missing_pattern", f"""WITH {ORDERS_N} SELECT o_orderkey, """ + ", ".join(
    f"CAST({_flag(c)} AS INT) AS {c}" for c in _ON_COLS if c != "o_orderkey")
    + f" FROM orders_n ORDER BY {hash_order('o_orderkey')}, o_orderkey LIMIT 100")
def missing_pattern(spark, sf):
    return P.missing_pattern(orders_nulls(spark, sf), "o_orderkey", 100)


@query("page_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 75")
def page_rows(spark, sf):
    return P.page(table(spark, sf, "orders"), "o_orderkey", 3)


@query("template_rows", "SELECT o_totalprice, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 3")
def template_rows(spark, sf):
    return P.template_rows(table(spark, sf, "orders"),
                           ["o_totalprice", "o_orderstatus", "o_orderpriority"], "o_orderkey")
