"""Metric queries over deterministic pseudo-predictions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd, round_all
from ..operators import metrics as M
from ..operators import split as S
from .fixtures import (BINARY_SQL, CLASSES, EMBED_SQL, MULTICLASS_SQL, REGRESSION_SQL, binary_preds,
                       embedding_clusters, multiclass_preds, regression_preds, vector_dim)
from .registry import query

_AUC_BIN = """sc AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM bp GROUP BY score),
cum AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS cneg FROM sc),
auc AS (SELECT sum(pos * (cneg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc FROM cum)"""


def _cls_sql(src, binary, pos="1"):
    per = f"""pc AS (SELECT coalesce(t.label, q.label) AS label, coalesce(t.n_true, 0) AS n_true, coalesce(t.tp, 0) AS tp,
    coalesce(q.n_pred, 0) AS n_pred FROM
    (SELECT CAST(y AS VARCHAR) AS label, count(*) AS n_true, count(*) FILTER (WHERE CAST(y AS VARCHAR) = CAST(pred AS VARCHAR)) AS tp
     FROM {src} GROUP BY 1) t FULL OUTER JOIN
    (SELECT CAST(pred AS VARCHAR) AS label, count(*) AS n_pred FROM {src} GROUP BY 1) q ON t.label = q.label),
  pm AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(n_pred, 0), 0.0) AS prec, coalesce(CAST(tp AS DOUBLE) / nullif(n_true, 0), 0.0) AS rec FROM pc),
  pf AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0) AS f1 FROM pm)"""
    if binary:
        sel = f"""max(CASE WHEN label = '{pos}' THEN prec END) AS precision, max(CASE WHEN label = '{pos}' THEN rec END) AS recall,
    max(CASE WHEN label = '{pos}' THEN f1 END) AS f1"""
    else:
        sel = """sum(n_true * prec) / sum(n_true) AS precision, sum(n_true * rec) / sum(n_true) AS recall,
    sum(n_true * f1) / sum(n_true) AS f1"""
    return per, f"""SELECT CAST(sum(tp) AS DOUBLE) / sum(n_true) AS accuracy, {sel},
    coalesce((CAST(sum(tp) AS DOUBLE) * sum(n_true) - sum(CAST(n_pred AS DOUBLE) * n_true))
      / nullif(sqrt((CAST(sum(n_true) AS DOUBLE) * sum(n_true) - sum(CAST(n_pred AS DOUBLE) * n_pred))
                  * (CAST(sum(n_true) AS DOUBLE) * sum(n_true) - sum(CAST(n_true AS DOUBLE) * n_true))), 0), 0.0) AS mcc FROM pf"""


_bper, _bsel = _cls_sql("bp", True)


@query("metrics_binary", f"""WITH {BINARY_SQL}, {_bper}, {_AUC_BIN}, c AS ({_bsel})
SELECT round(accuracy, 6) AS accuracy, round(coalesce(precision, 0.0), 6) AS precision, round(coalesce(recall, 0.0), 6) AS recall,
  round(coalesce(f1, 0.0), 6) AS f1, round(mcc, 6) AS mcc, round(roc_auc, 6) AS roc_auc FROM c, auc""")
def metrics_binary(spark, sf):
    bp = binary_preds(spark, sf)
    m = M.classification_metrics(bp, "y", "pred", binary=True, positive="1")
    return round_all(m.crossJoin(M.roc_auc(bp, "y", "score").select("roc_auc")), 6)


_mper, _msel = _cls_sql("mc", False)
_MC_LONG = " UNION ALL ".join(f"SELECT k, y, '{c}' AS cls, p_{c} AS score FROM mc" for c in CLASSES)


@query("metrics_multiclass", f"""WITH {MULTICLASS_SQL}, {_mper}, c AS ({_msel}),
lg AS ({_MC_LONG}),
sc AS (SELECT cls, score, sum(CAST(y = cls AS INT)) AS pos, sum(1 - CAST(y = cls AS INT)) AS neg FROM lg GROUP BY cls, score),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS UNBOUNDED PRECEDING) AS cneg FROM sc),
per AS (SELECT cls, sum(pos * (cneg - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) AS a, sum(pos) AS support FROM cum GROUP BY cls),
auc AS (SELECT sum(a * support) / sum(support) AS roc_auc FROM per WHERE support > 0)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(mcc, 6) AS mcc, round(roc_auc, 6) AS roc_auc FROM c, auc""")
def metrics_multiclass(spark, sf):
    mc = multiclass_preds(spark, sf)
    m = M.classification_metrics(mc, "y", "pred", binary=False)
    long = mc.select("k", "y", F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"p_{c}").alias("score"))
                                                   for c in CLASSES])).alias("e")).select("k", "y", "e.cls", "e.score")
    return round_all(m.crossJoin(M.roc_auc_ovr_weighted(long, "y", "cls", "score")), 6)


@query("confusion_matrix", f"""WITH {MULTICLASS_SQL}, l AS (SELECT y AS l FROM mc UNION SELECT pred FROM mc)
SELECT a.l AS actual, p.l AS predicted, CAST(count(mc.k) AS BIGINT) AS "count" FROM l a CROSS JOIN l p
LEFT JOIN mc ON mc.y = a.l AND mc.pred = p.l GROUP BY a.l, p.l""")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(multiclass_preds(spark, sf), "y", "pred")


_ROC_SQL = f"""WITH {BINARY_SQL}, sc AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM bp GROUP BY score),
cum AS (SELECT *, sum(neg) OVER w AS cneg, sum(pos) OVER w AS cpos FROM sc
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc),
pts AS (SELECT score AS threshold, cneg / N AS fpr, cpos / P AS tpr, (cneg - neg) / N AS fpr_prev, (cpos - pos) / P AS tpr_prev FROM cum, t)"""


@query("roc_curve", f"{_ROC_SQL} SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts")
def roc_curve(spark, sf):
    c = M.roc_curve(binary_preds(spark, sf), "y", "score")
    return round_all(c.select("threshold", "fpr", "tpr"), 6)


@query("roc_area", f"{_ROC_SQL} SELECT round(sum((fpr - fpr_prev) * (tpr + tpr_prev) / 2), 6) AS auc FROM pts")
def roc_area(spark, sf):
    return round_all(M.roc_area(M.roc_curve(binary_preds(spark, sf), "y", "score")), 6)


_PR_SQL = f"""WITH {BINARY_SQL}, sc AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM bp GROUP BY score),
cum AS (SELECT *, sum(neg) OVER w AS cneg, sum(pos) OVER w AS cpos FROM sc
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(pos) AS P FROM sc)"""


@query("pr_curve", f"""{_PR_SQL} SELECT round(score, 6) AS threshold, round(cpos / (cpos + cneg), 6) AS precision,
  round(cpos / P, 6) AS recall FROM cum, t WHERE cpos - pos < P
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0""")
def pr_curve(spark, sf):
    return round_all(M.pr_curve(binary_preds(spark, sf), "y", "score"), 6)


@query("average_precision", f"{_PR_SQL} SELECT round(sum(pos * cpos / (cpos + cneg)) / sum(pos), 6) AS average_precision FROM cum")
def average_precision(spark, sf):
    return round_all(M.average_precision(binary_preds(spark, sf), "y", "score"), 6)


@query("metrics_regression", f"""WITH {REGRESSION_SQL}, m AS (SELECT avg(y) AS ybar FROM rp),
r AS (SELECT avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, sum((y - p) * (y - p)) AS sse,
  sum((y - ybar) * (y - ybar)) AS sst FROM rp, m)
SELECT round(mse, 4) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
  round(CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END, 6) AS r2 FROM r""")
def metrics_regression(spark, sf):
    r = M.regression_metrics(regression_preds(spark, sf), "y", "p")
    return r.select(rnd("mse", 4).alias("mse"), *[rnd(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


@query("residual_histogram", f"""WITH {REGRESSION_SQL}, r AS (SELECT y - p AS resid FROM rp),
st AS (SELECT min(resid) AS lo, max(resid) AS hi FROM r)
SELECT CAST({' + '.join(f"(CASE WHEN resid >= {float(i)} * ((hi - lo) / 20.0) + lo THEN 1 ELSE 0 END)" for i in range(1, 20))} AS INT) AS bin,
  CAST(count(*) AS BIGINT) AS "count", round(avg(resid), 6) AS mean_resid FROM r, st GROUP BY 1""")
def residual_histogram(spark, sf):
    h = M.residual_histogram(regression_preds(spark, sf), "y", "p", 20)
    return round_all(h.withColumn("bin", F.col("bin").cast("int")), 6)


@query("prediction_interval", f"""WITH {REGRESSION_SQL},
sp AS (SELECT *, CASE WHEN rk < nt THEN 'test' WHEN rk < nt + nv THEN 'val' ELSE 'train' END AS split FROM
  (SELECT *, ceil(CAST(0.2 AS DECIMAL(20,9)) * n) AS nt, ceil(CAST(0.125 AS DECIMAL(20,9)) * (n - ceil(CAST(0.2 AS DECIMAL(20,9)) * n))) AS nv FROM
   (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || CAST(k AS VARCHAR)), 1, 8))::BIGINT, k) - 1 AS rk, count(*) OVER () AS n FROM rp))),
q AS (SELECT quantile_cont(y - p, 0.025) AS lo, quantile_cont(y - p, 0.975) AS hi FROM sp WHERE split = 'train')
SELECT round(lo, 6) AS q_lower, round(hi, 6) AS q_upper,
  round(avg(CAST(y >= p + lo AND y <= p + hi AS INT)), 6) AS coverage FROM sp, q WHERE split = 'test' GROUP BY lo, hi""")
def prediction_interval(spark, sf):
    rp = S.assign_split(regression_preds(spark, sf), "k")
    tr, te = rp.where("split = 'train'"), rp.where("split = 'test'")
    iv = M.prediction_interval(tr, te, "y", "p", 0.95)
    out = iv.agg(F.first(F.col("lower") - F.col("p")).alias("q_lower"),
                 F.first(F.col("upper") - F.col("p")).alias("q_upper"),
                 F.avg(((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).cast("int")).alias("coverage"))
    return round_all(out, 6)


@query("silhouette_sq", f"""WITH {EMBED_SQL},
d AS (SELECT a.vec_id, a.lab AS own, b.lab AS other, pow(list_distance(a.x, b.x), 2) AS d2 FROM e a JOIN e b ON a.lab >= 0 AND b.lab >= 0),
g AS (SELECT vec_id, own, other, sum(d2) AS tot, count(*) AS n FROM d GROUP BY ALL),
p AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n_own, max(CASE WHEN own = other THEN tot / (n - 1) END) AS a,
  min(CASE WHEN own <> other THEN tot / n END) AS b FROM g GROUP BY vec_id)
SELECT round(CASE WHEN (SELECT count(DISTINCT lab) FROM e WHERE lab >= 0) >= 2 THEN avg(CASE WHEN n_own <= 1 THEN 0.0
  ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) END, 6) AS silhouette FROM p""")
def silhouette_sq(spark, sf):
    e = embedding_clusters(spark, sf)
    return round_all(M.silhouette_sq(e, "embedding", "label", vector_dim(e, "embedding")), 6)


@query("clustering_metrics", f"""WITH {EMBED_SQL},
l AS (SELECT vec_id, lab, i, x[i] AS v FROM e, range(1, 65) t(i) WHERE lab >= 0),
mu AS (SELECT lab, i, avg(v) AS m FROM l GROUP BY lab, i),
cn AS (SELECT lab, count(*) AS n FROM e WHERE lab >= 0 GROUP BY lab),
pd AS (SELECT l.vec_id, l.lab, sum((v - m) * (v - m)) AS d2 FROM l JOIN mu USING (lab, i) GROUP BY l.vec_id, l.lab),
si AS (SELECT lab, avg(sqrt(d2)) AS s, sum(d2) AS w FROM pd GROUP BY lab),
cd AS (SELECT a.lab AS la, b.lab AS lb, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM mu a JOIN mu b ON a.i = b.i AND a.lab <> b.lab GROUP BY a.lab, b.lab),
db AS (SELECT avg(r) AS db FROM (SELECT la, max((sa.s + sb.s) / d) AS r FROM cd JOIN si sa ON sa.lab = la JOIN si sb ON sb.lab = lb GROUP BY la)),
g AS (SELECT i, avg(v) AS gm FROM l GROUP BY i),
bb AS (SELECT sum(n * (m - gm) * (m - gm)) AS B FROM mu JOIN g USING (i) JOIN cn USING (lab)),
tot AS (SELECT count(*) AS K, sum(n) AS N FROM cn), ww AS (SELECT sum(w) AS W FROM si)
SELECT CAST(K AS BIGINT) AS n_clusters, round(CASE WHEN K >= 2 THEN db END, 6) AS davies_bouldin,
  round(CASE WHEN K >= 2 THEN CASE WHEN W = 0 THEN 1.0 ELSE B * (N - K) / (W * (K - 1)) END END, 6) AS calinski_harabasz
FROM tot, db, bb, ww""")
def clustering_metrics(spark, sf):
    e = embedding_clusters(spark, sf)
    return round_all(M.clustering_metrics(e, "embedding", "label", vector_dim(e, "embedding")), 6)


@query("anomaly_metrics", f"""WITH {BINARY_SQL}, a AS (SELECT y, CAST(score > 0.9 AS INT) AS flag FROM bp),
s AS (SELECT CAST(count(*) FILTER (WHERE flag = 1) AS DOUBLE) AS na, count(*) AS n,
  CAST(count(*) FILTER (WHERE flag = 1 AND y = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE y = 1) AS nt FROM a)
SELECT na AS n_anomalies, round(coalesce(na / nullif(n, 0), 0.0), 6) AS anomaly_ratio,
  round(coalesce(tp / nullif(na, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(nt, 0), 0.0), 6) AS recall,
  round(coalesce(2 * (tp / nullif(na, 0)) * (tp / nullif(nt, 0)) / nullif(tp / nullif(na, 0) + tp / nullif(nt, 0), 0), 0.0), 6) AS f1 FROM s""")
def anomaly_metrics(spark, sf):
    bp = binary_preds(spark, sf).withColumn("flag", (F.col("score") > 0.9).cast("int"))
    return round_all(M.anomaly_metrics(bp, "flag", "y"), 6)


@query("score_histogram", f"""WITH {BINARY_SQL}, st AS (SELECT min(score) AS lo, max(score) AS hi FROM bp),
b AS (SELECT {' + '.join(f"(CASE WHEN score >= {float(i)} * ((hi - lo) / 40.0) + lo THEN 1 ELSE 0 END)" for i in range(1, 40))} AS bin, lo, hi FROM bp, st)
SELECT CAST(bin AS BIGINT) AS bin, round(lo + bin * ((hi - lo) / 40.0), 6) AS bin_lo, CAST(count(*) AS BIGINT) AS "count",
  lo + bin * ((hi - lo) / 40.0) >= 0.9 AS above_threshold FROM b GROUP BY bin, lo, hi""")
def score_histogram(spark, sf):
    return round_all(M.score_histogram(binary_preds(spark, sf), "score", 40, 0.9), 6)


@query("cluster_centroids", f"""WITH {EMBED_SQL}
SELECT lab AS cluster, CAST(count(*) OVER (PARTITION BY lab) / 64 AS BIGINT) AS n, CAST(i - 1 AS INT) AS component, round(m, 6) AS mean FROM
  (SELECT lab, i, avg(x[i]) AS m, count(*) AS c FROM e, range(1, 65) t(i) GROUP BY lab, i) q""".replace(
    "count(*) OVER (PARTITION BY lab) / 64", "c"))
def cluster_centroids(spark, sf):
    e = embedding_clusters(spark, sf)
    c = M.cluster_centroids(e, "embedding", "label", vector_dim(e, "embedding"))
    out = c.select("cluster", "n", F.posexplode("centroid").alias("component", "mean"))
    return round_all(out.withColumn("component", F.col("component").cast("int")), 6)


# --------------------------------------------------------- summaries, top-k
from .fixtures import MULTICLASS_SQL as _MC  # noqa: E402,F811


@query("prediction_summary_classes", f"""WITH {_MC}
SELECT pred AS value, CAST(count(*) AS BIGINT) AS "count", round(count(*) * 100.0 / (SELECT count(*) FROM mc), 6) AS percentage
FROM mc GROUP BY pred""")
def prediction_summary_classes(spark, sf):
    return round_all(M.prediction_summary_classes(multiclass_preds(spark, sf), "pred"), 6)


@query("prediction_summary_values", f"""WITH {REGRESSION_SQL}
SELECT round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, round(min(p), 6) AS "min", round(max(p), 6) AS "max" FROM rp""")
def prediction_summary_values(spark, sf):
    return round_all(M.prediction_summary_values(regression_preds(spark, sf), "p"), 6)


@query("top_anomalies", f"""WITH {BINARY_SQL} SELECT k, round(score, 6) AS score FROM bp ORDER BY score DESC, k LIMIT 20""")
def top_anomalies(spark, sf):
    return round_all(M.top_anomalies(binary_preds(spark, sf), "score", "k", 20).select("k", "score"), 6)
