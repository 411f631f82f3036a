"""Model-side operators checked in closed form: two-column PCA, attribution of a
single slope, elbow and improvement rules, retraining advice, clipping, and the
frame that is scored."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import clip_negative, rnd, round_all
from ..models import extra as EX
from ..models import reduction as RD
from ..models import retrain as RT
from ..operators import drift as D
from ..operators import prep as PR
from ..sources.tables import table
from . import q_drift
from .registry import ORACLES, query

XY = ["quantity", "price"]


def _xy(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice") / 1000).alias("price"))


EIGEN = """WITH xy AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM xy),
l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM m),
t AS (SELECT CAST(1 AS INTEGER) AS component, l1 AS explained_variance, l1 / (l1 + l2) AS ratio, l1 / (l1 + l2) AS cumulative FROM l
  UNION ALL SELECT CAST(2 AS INTEGER), l2, l2 / (l1 + l2), 1.0 FROM l)"""


@query("pca_two_columns", f"""{EIGEN} SELECT component, round(explained_variance, 6) AS explained_variance,
  round(ratio, 6) AS ratio, round(cumulative, 6) AS cumulative FROM t""")
def pca_two_columns(spark, sf):
    return round_all(RD.pca(_xy(spark, sf), XY, 2).variance_table(spark), 6)


@query("pca_two_columns_needed", f"""{EIGEN} SELECT CAST(least(greatest(coalesce(min(component) FILTER (cumulative >= 0.95),
  max(component)), 1), max(component)) AS INTEGER) AS n_components FROM t""")
def pca_two_columns_needed(spark, sf):
    return RD.components_for_variance(RD.pca(_xy(spark, sf), XY, 2).variance_table(spark), 0.95)


@query("pca_two_columns_loadings", f"""{EIGEN},
v AS (SELECT 1 AS component, b AS p, l1 - a AS q FROM l UNION ALL SELECT 2, b, l2 - a FROM l),
u AS (SELECT component, p / sqrt(p * p + q * q) AS p, q / sqrt(p * p + q * q) AS q FROM v),
f AS (SELECT component, CASE WHEN abs(p) >= abs(q) THEN sign(p) ELSE sign(q) END AS s, p, q FROM u),
w AS (SELECT component, 'quantity' AS feature, s * p AS loading FROM f UNION ALL SELECT component, 'price', s * q FROM f)
SELECT CAST(component AS INTEGER) AS component, feature, round(loading, 6) AS loading,
  CAST(row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS INTEGER) AS rank FROM w""")
def pca_two_columns_loadings(spark, sf):
    return round_all(RD.top_loadings(RD.pca(_xy(spark, sf), XY, 2), spark, 10, 5), 6)


@query("slope_attribution", """WITH xy AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000 AS y FROM lineitem),
m AS (SELECT regr_slope(y, x) AS w, avg(x) AS mx FROM xy)
SELECT 'quantity' AS feature, round(avg(abs(w * (x - mx))), 6) AS mean_abs FROM xy, m""")
def slope_attribution(spark, sf):
    df = _xy(spark, sf).withColumn("id", F.monotonically_increasing_id())
    slope = df.agg(F.regr_slope("price", "quantity")).first()[0]
    return round_all(EX.mean_abs_attribution(EX.linear_attribution(df, ["quantity"], [slope], "id")), 6)


SCAN = """scan AS (SELECT CAST(l_linenumber AS INTEGER) AS k, sum(CAST(l_quantity AS DOUBLE)) AS inertia,
  round(avg(l_discount), 6) AS silhouette FROM lineitem GROUP BY l_linenumber)"""


@query("elbow_rule", f"""WITH {SCAN}, d AS (SELECT k, silhouette,
  lead(inertia) OVER (ORDER BY k) - 2 * inertia + lag(inertia) OVER (ORDER BY k) AS d2 FROM scan)
SELECT (SELECT k FROM d WHERE d2 IS NOT NULL ORDER BY d2 DESC, k LIMIT 1) AS elbow_k,
  (SELECT k FROM d ORDER BY silhouette DESC, k LIMIT 1) AS best_silhouette_k""")
def elbow_rule(spark, sf):
    """W3 on a scan of one row per line number."""
    scan = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("k")).agg(
        F.sum(F.col("l_quantity").cast("double")).alias("inertia"), rnd(F.avg("l_discount"), 6).alias("silhouette"))
    return EX.elbow(scan)


PAIRS = """p AS (SELECT CAST(l_linenumber AS INTEGER) AS line, avg(l_discount) FILTER (l_returnflag = 'A' AND l_linenumber <> 3) AS o,
  avg(l_discount) FILTER (l_returnflag = 'R' AND l_linenumber <> 5) AS n FROM lineitem GROUP BY l_linenumber)"""


@query("improvement_rule", f"""WITH {PAIRS} SELECT line,
  CASE WHEN o IS NULL THEN true WHEN n IS NULL THEN false ELSE n > o END AS better,
  CASE WHEN o IS NULL THEN true WHEN n IS NULL THEN false ELSE abs(n - o) < 0.05 OR n < o END AS anomaly_better FROM p""")
def improvement_rule(spark, sf):
    """X2 on pairs of mean discounts, one side missing for two of the lines."""
    mean = lambda flag, gap: F.avg(F.when((F.col("l_returnflag") == flag) & (F.col("l_linenumber") != gap), F.col("l_discount")))
    p = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("line")).agg(
        mean("A", 3).alias("o"), mean("R", 5).alias("n"))
    return p.select("line", RT.improved_expr("o", "n", "regression").alias("better"),
                    RT.improved_expr("o", "n", "anomaly_detection").alias("anomaly_better"))


@query("drift_retrain_advice", f"""SELECT drift_rate, drifted_column_names, drift_rate > 0 AS retrain_advised
FROM ({ORACLES['drift_summary']})""")
def drift_retrain_advice(spark, sf):
    return RT.retrain_advice(D.drift_summary(q_drift.drift_report(spark, sf)))


@query("clip_for_factors", """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_acctbal < 0 THEN 0.0
  ELSE c_acctbal END AS acct FROM customer""")
def clip_for_factors(spark, sf):
    """negative values become 0, null stays null."""
    acct = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", clip_negative(acct).alias("acct"))


@query("scoring_frame", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def scoring_frame(spark, sf):
    """P10: the frame to score has no target."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return PR.drop_target(o, "o_orderstatus")
