"""Drift queries on lineitem split at 1998-01-01 (reference = earlier)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators.kinds import kinds_map
from ..sources.tables import table
from . import oracle_drift as O
from .registry import query

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus"]
CUT = "1998-01-01"
REF_PRED_SQL = f"l_shipdate < TIMESTAMP '{CUT}'"


def lineitem_sides(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < cut), li.where(F.col("l_shipdate") >= cut)


def lineitem_sided(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return D.with_sides(li, F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz"))


def drift_report(spark, sf_dir):
    sided = lineitem_sided(spark, sf_dir)
    feats = NUM + CAT
    ref, _ = lineitem_sides(spark, sf_dir)
    kinds = kinds_map(ref.select(*feats))
    return D.detect_drift(sided, None, kinds, feats)


REPORT_SQL = O.drift_report_sql("lineitem", NUM, CAT, REF_PRED_SQL)
query("drift_report", REPORT_SQL)(drift_report)


@query("drift_numeric", O.numeric_drift_sql("lineitem", NUM, REF_PRED_SQL))
def drift_numeric(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return D.drift_numeric(ref, cur, NUM).drop("ordinal")


@query("drift_categorical", O.categorical_drift_sql("lineitem", CAT, REF_PRED_SQL))
def drift_categorical(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return D.drift_categorical(ref, cur, CAT).drop("ordinal")


@query("drift_summary", O.drift_summary_sql(REPORT_SQL))
def drift_summary(spark, sf_dir):
    return D.drift_summary(drift_report(spark, sf_dir))


# ------------------------------------------------ prediction / cluster drift
EV_CUT = "2024-01-16"


def _events_sides(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    cut = F.lit(EV_CUT).cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


_VERDICT_SQL = """CASE WHEN {psi} < 0.1 AND {p} >= 0.05 THEN 'none' WHEN {psi} < 0.25 OR {p} >= 0.05 THEN 'possible'
  ELSE 'significant' END"""


def _concept_classes_sql():
    return f"""WITH ev AS (SELECT event_type AS v, CASE WHEN ts < TIMESTAMP '{EV_CUT}' THEN 0 ELSE 1 END AS side FROM events),
c AS (SELECT v, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM ev GROUP BY v),
t AS (SELECT sum(a) AS NA, sum(b) AS NB, count(*) AS K, count(*) FILTER (WHERE a > 0) AS k,
  sum(CASE WHEN a > 0 THEN CAST(b AS DOUBLE) END) AS obs, sum(CASE WHEN a > 0 THEN CAST(a AS DOUBLE) END) AS sa FROM c),
s AS (SELECT sum(((b + 1e-8) / (NB + 1e-8 * K) - (a + 1e-8) / (NA + 1e-8 * K)) * ln(((b + 1e-8) / (NB + 1e-8 * K)) / ((a + 1e-8) / (NA + 1e-8 * K)))) AS psi_raw,
  sum(CASE WHEN a > 0 THEN (b - CAST(a AS DOUBLE) / NA * NB) * (b - CAST(a AS DOUBLE) / NA * NB) / (CAST(a AS DOUBLE) / NA * NB) END) AS stat,
  sum(CASE WHEN a > 0 THEN CAST(a AS DOUBLE) / NA * NB END) AS exp_, min(obs) AS obs, min(k) AS k, min(NA) AS NA, min(NB) AS NB FROM c, t),
v AS (SELECT psi_raw, CASE WHEN NA > 0 AND NB > 0 AND k >= 2 AND abs(obs - exp_) <= {O.CHI2_RTOL} * greatest(obs, exp_) THEN stat END AS st, k FROM s),
w AS (SELECT psi_raw, coalesce(st, 0.0) AS stat, coalesce({O.chi2_sf_sql('st', '(k - 1)')}, 1.0) AS p FROM v)
SELECT 'event_type' AS "column", round(stat, 4) AS statistic, round(p, 4) AS p_value, round(psi_raw, 4) AS psi,
  {_VERDICT_SQL.format(psi='psi_raw', p='p')} AS verdict FROM w"""


@query("concept_drift_classes", _concept_classes_sql())
def concept_drift_classes(spark, sf_dir):
    ref, cur = _events_sides(spark, sf_dir)
    return D.concept_drift_categorical(ref, cur, "event_type")


@query("concept_drift_values", f"""SELECT "column", ks_statistic AS statistic, ks_pvalue AS p_value, psi,
  {_VERDICT_SQL.format(psi='psi', p='ks_pvalue')} AS verdict
FROM ({O.numeric_drift_sql('events', ['value'], f"ts < TIMESTAMP '{EV_CUT}'")})""")
def concept_drift_values(spark, sf_dir):
    ref, cur = _events_sides(spark, sf_dir)
    return D.concept_drift_numeric(ref, cur, "value")


def _emb_sides(spark, sf_dir):
    from ..operators.split import assign_split
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    s = assign_split(e, "vec_id")
    return s.where("split = 'train'"), s.where("split <> 'train'")


def _emb_split_sql():
    from .q_prep import split_sql
    return f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), sp AS ({split_sql('e', 'vec_id')}),
tr AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split <> 'train')"""


@query("cluster_share_drift", f"""WITH {_emb_split_sql()},
c AS (SELECT coalesce(r.label, n.label) AS label, coalesce(r.a, 0) AS a, coalesce(n.b, 0) AS b FROM
  (SELECT label, count(*) AS a FROM tr GROUP BY label) r FULL OUTER JOIN (SELECT label, count(*) AS b FROM te GROUP BY label) n ON r.label = n.label),
t AS (SELECT sum(a) AS NA, sum(b) AS NB, count(*) FILTER (WHERE a > 0) AS k, count(*) FILTER (WHERE b > 0) AS kc,
  sum(CASE WHEN a > 0 THEN CAST(b AS DOUBLE) END) AS obs FROM c),
s AS (SELECT sum((CAST(b AS DOUBLE) / NB - CAST(a AS DOUBLE) / NA) * ln(greatest(CAST(b AS DOUBLE) / NB, 1e-9) / greatest(CAST(a AS DOUBLE) / NA, 1e-9))) AS psi_raw,
  sum(CASE WHEN a > 0 THEN (b - CAST(a AS DOUBLE) / NA * NB) * (b - CAST(a AS DOUBLE) / NA * NB) / (CAST(a AS DOUBLE) / NA * NB) END) AS stat,
  sum(CASE WHEN a > 0 THEN CAST(a AS DOUBLE) / NA * NB END) AS exp_, min(obs) AS obs, min(k) AS k, min(kc) AS kc, min(NA) AS NA, min(NB) AS NB FROM c, t),
v AS (SELECT psi_raw, kc, k, CASE WHEN k < 2 THEN 0.0 WHEN NA > 0 AND NB > 0 AND abs(obs - exp_) <= {O.CHI2_RTOL} * greatest(obs, exp_) THEN stat END AS st FROM s),
w AS (SELECT psi_raw, kc, st, CASE WHEN k < 2 THEN 1.0 ELSE {O.chi2_sf_sql('st', '(k - 1)')} END AS p FROM v)
SELECT 'label' AS "column", round(st, 4) AS chi2_statistic, round(p, 4) AS chi2_pvalue, round(psi_raw, 4) AS psi,
  CAST(kc AS BIGINT) AS n_clusters, {_VERDICT_SQL.format(psi='psi_raw', p='coalesce(p, 0.0)')} AS verdict FROM w""")
def cluster_share_drift(spark, sf_dir):
    tr, te = _emb_sides(spark, sf_dir)
    return D.cluster_share_drift(tr, te, "label")


@query("boundary_outliers", f"""WITH {_emb_split_sql()},
cen AS (SELECT label, i, avg(x[i]) AS m FROM tr, range(1, 65) t(i) GROUP BY label, i),
dtr AS (SELECT tr.vec_id, sqrt(sum((tr.x[t.i] - cen.m) * (tr.x[t.i] - cen.m))) AS d FROM tr, range(1, 65) t(i)
  JOIN cen ON cen.label = tr.label AND cen.i = t.i GROUP BY tr.vec_id),
thr AS (SELECT quantile_cont(d, 0.95) AS thr FROM dtr),
dte AS (SELECT te.vec_id, coalesce(sqrt(sum((te.x[t.i] - cen.m) * (te.x[t.i] - cen.m))), CAST('inf' AS DOUBLE)) AS d FROM te, range(1, 65) t(i)
  LEFT JOIN cen ON cen.label = te.label AND cen.i = t.i GROUP BY te.vec_id)
SELECT round(thr, 6) AS threshold, CAST(count(*) FILTER (WHERE d > thr) AS BIGINT) AS n_outside,
  round(count(*) FILTER (WHERE d > thr) / count(*), 6) AS rate, count(*) FILTER (WHERE d > thr) / count(*) > 0.1 AS warn
FROM dte, thr GROUP BY thr""")
def boundary_outliers(spark, sf_dir):
    tr, te = _emb_sides(spark, sf_dir)
    from .fixtures import vector_dim
    return D.boundary_outliers(tr, te, "x", "label", vector_dim(tr, "x"))


@query("features_by_psi", f"""SELECT "column", psi, CAST(row_number() OVER (ORDER BY psi DESC, "column") AS BIGINT) AS rank
FROM ({REPORT_SQL}) WHERE error IS NULL""")
def features_by_psi(spark, sf_dir):
    """Tested features ordered by PSI (descending); one row per column."""
    from pyspark.sql import Window
    rep = drift_report(spark, sf_dir).where(F.col("error").isNull())
    return rep.select("column", "psi", F.row_number().over(Window.orderBy(F.desc("psi"), "column"))
                      .cast("bigint").alias("rank"))


@query("overlay_numeric", f"""WITH v AS (SELECT l_extendedprice AS value, CASE WHEN l_shipdate < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS side FROM lineitem),
st AS (SELECT min(value) AS lo, max(value) AS hi, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM v),
b AS (SELECT {' + '.join(f"(CASE WHEN value >= {float(i)} * ((hi - lo) / 30.0) + lo THEN 1 ELSE 0 END)" for i in range(1, 30))} AS bin, side FROM v, st)
SELECT CAST(bin AS BIGINT) AS bin, round(lo + bin * ((hi - lo) / 30.0), 6) AS bin_lo,
  round(count(*) FILTER (WHERE side = 0) / na, 6) AS ref_share, round(count(*) FILTER (WHERE side = 1) / nb, 6) AS cur_share
FROM b, st GROUP BY bin, lo, hi, na, nb""")
def overlay_numeric(spark, sf_dir):
    """Normalised histograms of reference and current (30 bins)."""
    ref, cur = lineitem_sides(spark, sf_dir)
    return D.overlay_numeric(ref, cur, "l_extendedprice", 30)


@query("overlay_categorical", f"""WITH r AS (SELECT l_returnflag AS category, count(*) * 1.0 / (SELECT count(*) FROM lineitem WHERE {REF_PRED_SQL}) AS ref_share
  FROM lineitem WHERE {REF_PRED_SQL} GROUP BY 1),
c AS (SELECT l_returnflag AS category, count(*) * 1.0 / (SELECT count(*) FROM lineitem WHERE NOT ({REF_PRED_SQL})) AS cur_share
  FROM lineitem WHERE NOT ({REF_PRED_SQL}) GROUP BY 1)
SELECT coalesce(r.category, c.category) AS category, round(coalesce(ref_share, 0.0), 6) AS ref_share,
  round(coalesce(cur_share, 0.0), 6) AS cur_share FROM r FULL OUTER JOIN c ON r.category IS NOT DISTINCT FROM c.category""")
def overlay_categorical(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return D.overlay_categorical(ref, cur, "l_returnflag")
