"""Evaluation metrics (E1-E17, C2) as aggregations.

Confusion-matrix family: one ``groupBy(y, p)`` (at most classes² rows) and
closed forms over it.  Ranking family (AUC, ROC, PR, AP): rows are first
aggregated by score, then ranked with bucketed running sums, so no window
ever holds the whole table in one task.  Clustering family: per-cluster
sufficient statistics (n, Σx, Σ|x|²) broadcast back to the points — linear
in rows, never pairwise."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hist_bin
from .running import running_sums, sized



def _d(c) -> Column:
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(_d(a), _d(b)), F.lit(0.0))


# ------------------------------------------------------------ confusion set

def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts over the full label grid (labels of truth ∪ prediction),
    zero cells included."""
    labels = (df.select(F.col(y).cast("string").alias("l"))
              .union(df.select(F.col(p).cast("string").alias("l"))).where("l is not null").distinct())
    grid = labels.select(F.col("l").alias("actual")).crossJoin(labels.select(F.col("l").alias("predicted")))
    cnt = df.groupBy(F.col(y).cast("string").alias("actual"),
                     F.col(p).cast("string").alias("predicted")).agg(F.count("*").alias("n"))
    return (grid.join(cnt, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("count")))


def _per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, tp, n_true, n_pred) for every label in truth ∪ prediction,
    all from one ``groupBy(y, p)`` of at most classes² rows."""
    cells = df.groupBy(F.col(y).cast("string").alias("yy"), F.col(p).cast("string").alias("pp")) \
        .agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(
        F.struct(F.col("yy").alias("label"), F.col("n").alias("n_true"),
                 F.when(F.col("yy") == F.col("pp"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.lit(0).cast("bigint").alias("n_pred")),
        F.struct(F.col("pp").alias("label"), F.lit(0).cast("bigint").alias("n_true"),
                 F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("n_pred")))).alias("e"))
    return long.select("e.*").where(F.col("label").isNotNull()).groupBy("label").agg(
        F.sum("n_true").alias("n_true"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"))


def classification_metrics(df: DataFrame, y: str, p: str, binary: bool,
                           positive: str = "1") -> DataFrame:
    """Accuracy; precision/recall/F1 (binary on ``positive``, else
    support-weighted; zero division → 0); MCC (multiclass form, 0 when
    undefined)."""
    pc = _per_class(df, y, p)
    prec = _ratio("tp", "n_pred")
    rec = _ratio("tp", "n_true")
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    pc = pc.select("*", prec.alias("prec"), rec.alias("rec"), f1.alias("f1"))
    n = F.sum("n_true").cast("double")
    c = F.sum("tp").cast("double")
    spk = F.sum(F.col("n_pred").cast("double") * F.col("n_true"))
    sp2 = F.sum(F.col("n_pred").cast("double") * F.col("n_pred"))
    st2 = F.sum(F.col("n_true").cast("double") * F.col("n_true"))
    mcc = F.coalesce(F.try_divide(c * n - spk, F.sqrt((n * n - sp2) * (n * n - st2))), F.lit(0.0))
    if binary:
        pos = F.col("label") == F.lit(str(positive))
        agg = [F.max(F.when(pos, F.col("prec"))).alias("precision"),
               F.max(F.when(pos, F.col("rec"))).alias("recall"),
               F.max(F.when(pos, F.col("f1"))).alias("f1")]
    else:
        w = F.col("n_true").cast("double")
        agg = [(F.sum(w * F.col("prec")) / n).alias("precision"),
               (F.sum(w * F.col("rec")) / n).alias("recall"),
               (F.sum(w * F.col("f1")) / n).alias("f1")]
    out = pc.agg((c / n).alias("accuracy"), *agg, mcc.alias("mcc"))
    return out.select("accuracy", *[F.coalesce(F.col(k), F.lit(0.0)).alias(k)
                                    for k in ("precision", "recall", "f1")], "mcc")


# ------------------------------------------------------------ ranking set

def score_counts(df: DataFrame, y, score: str, group: Sequence[str] = ()) -> DataFrame:
    """(group…, score, pos, neg) — one row per distinct score."""
    pos = _d(y) if not isinstance(y, Column) else y.cast("double")
    return df.groupBy(*group, F.col(score).cast("double").alias("score")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def roc_auc(df: DataFrame, y, score: str, group: Sequence[str] = ()) -> DataFrame:
    """E5: AUC = Σ_s pos_s·(neg below s + ½·neg_s) / (P·N), i.e. the
    rank-sum statistic with mid-ranks for tied scores."""
    group = list(group)
    sc, n = sized(score_counts(df, y, score, group))
    cum = running_sums(sc, group, "score", ["neg", "pos"], n_rows=n)
    term = F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))
    return cum.groupBy(*group).agg(
        F.try_divide(F.sum(term), F.sum("pos") * F.sum("neg")).alias("roc_auc"),
        F.sum("pos").alias("support"))


def roc_auc_ovr_weighted(long: DataFrame, label: str, cls: str, score: str) -> DataFrame:
    """E5 multiclass: one-vs-rest AUC per class weighted by class support.
    ``long`` has one row per (row, class) with that class's score."""
    is_pos = (F.col(label).cast("string") == F.col(cls).cast("string")).cast("double")
    per = roc_auc(long.withColumn("_pos", is_pos), "_pos", score, [cls]).where(F.col("support") > 0)
    return per.agg((F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")).alias("roc_auc"))


def roc_curve(df: DataFrame, y, score: str, group: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score (descending thresholds): fpr, tpr;
    plus the area by trapezoids (equals :func:`roc_auc`)."""
    group = list(group)
    sc, n = sized(score_counts(df, y, score, group))
    cum = running_sums(sc, group, "score", ["neg", "pos"], descending=True, n_rows=n)
    tot = sc.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = cum.join(F.broadcast(tot), group) if group else cum.crossJoin(F.broadcast(tot))
    return j.select(*group, F.col("score").alias("threshold"),
                    F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"),
                    F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"),
                    F.try_divide(F.col("cum_neg") - F.col("neg"), F.col("N")).alias("fpr_prev"),
                    F.try_divide(F.col("cum_pos") - F.col("pos"), F.col("P")).alias("tpr_prev"))


def roc_area(curve: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*group).agg(F.sum((F.col("fpr") - F.col("fpr_prev"))
                                           * (F.col("tpr") + F.col("tpr_prev")) / 2).alias("auc"))


def pr_curve(df: DataFrame, y, score: str) -> DataFrame:
    """precision/recall at each distinct threshold until full recall is
    first reached, plus the (precision 1, recall 0) end point."""
    sc, n = sized(score_counts(df, y, score))
    cum = running_sums(sc, [], "score", ["neg", "pos"], descending=True, n_rows=n)
    tot = sc.agg(F.sum("pos").alias("P"))
    j = cum.crossJoin(F.broadcast(tot)).where(F.col("cum_pos") - F.col("pos") < F.col("P"))
    pts = j.select(F.col("score").alias("threshold"),
                   F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                   F.try_divide(F.col("cum_pos"), F.col("P")).alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def average_precision(df: DataFrame, y, score: str, group: Sequence[str] = ()) -> DataFrame:
    """AP = Σ_s (pos_s / P) · precision_s over descending thresholds."""
    group = list(group)
    sc, n = sized(score_counts(df, y, score, group))
    cum = running_sums(sc, group, "score", ["neg", "pos"], descending=True, n_rows=n)
    prec = F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return cum.groupBy(*group).agg(F.try_divide(F.sum(F.col("pos") * prec), F.sum("pos"))
                                   .alias("average_precision"))


# ----------------------------------------------------------- regression set

def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """MSE, RMSE, MAE, R² (1 − SSE/SST; SST = 0 → 1 if perfect else 0).
    Two passes only for the mean of y, folded into one aggregation via the
    identity SST = Σy² − n·ȳ² computed on centred values."""
    yy, pp = _d(y), _d(p)
    m = df.agg(F.avg(yy).alias("ybar"))
    j = df.crossJoin(F.broadcast(m))
    r = j.agg(F.avg((yy - pp) * (yy - pp)).alias("mse"), F.avg(F.abs(yy - pp)).alias("mae"),
              F.sum((yy - pp) * (yy - pp)).alias("sse"),
              F.sum((yy - F.col("ybar")) * (yy - F.col("ybar"))).alias("sst"))
    r2 = (F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("sse") / F.col("sst")))
    return r.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def residual_histogram(df: DataFrame, y: str, p: str, bins: int = 20) -> DataFrame:
    """Residuals y − p binned over their range (display form)."""
    res = df.select((_d(y) - _d(p)).alias("resid"))
    st = res.agg(F.min("resid").alias("lo"), F.max("resid").alias("hi"))
    j = res.crossJoin(F.broadcast(st)).withColumn("bin", hist_bin("resid", "lo", "hi", bins))
    return j.groupBy("bin").agg(F.count("*").cast("bigint").alias("count"),
                                F.avg("resid").alias("mean_resid"))


def prediction_interval(train: DataFrame, score: DataFrame, y: str, p: str, level: float = 0.95) -> DataFrame:
    """Prediction ± residual quantiles (a/2, 1 − a/2) from training rows."""
    from .quantiles import fitted_quantiles
    a = 1 - level
    res = train.select((_d(y) - _d(p)).alias("resid"))
    q = fitted_quantiles(res, ["resid"], [a / 2, 1 - a / 2])["resid"]
    return score.select("*", (_d(p) + F.lit(q[0])).alias("lower"), (_d(p) + F.lit(q[1])).alias("upper"))


# ----------------------------------------------------------- clustering set

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _vec_sum(col: str, dim: int) -> list[Column]:
    return [F.sum(F.col(col)[i]).alias(f"_s{i}") for i in range(dim)]


def cluster_stats(df: DataFrame, vec: str, label: str, dim: int) -> DataFrame:
    """Per cluster (noise −1 excluded): n, Σx (array), Σ|x|²."""
    x = df.where(F.col(label) >= 0).select(F.col(label).alias("cluster"),
                                           F.col(vec).cast("array<double>").alias("x"))
    g = x.groupBy("cluster").agg(F.count("*").alias("n"), *_vec_sum("x", dim),
                                 F.sum(_dot(F.col("x"), F.col("x"))).alias("q"))
    return g.select("cluster", "n", F.array(*[F.col(f"_s{i}") for i in range(dim)]).alias("s"), "q")


#: Clusters whose sums one row carries when points meet all clusters.
CLUSTER_BLOCK = 500


def silhouette_sq(df: DataFrame, vec: str, label: str, dim: int) -> DataFrame:
    """E11 (squared Euclidean, exact): for x in A,
    Σ_{y∈C}|x−y|² = n_C|x|² − 2x·S_C + Q_C, so a(x) and b(x) need only the
    per-cluster sums (n, S, Q).  These are packed into blocks of clusters; a
    point meets every block and keeps its own term and the least other one.
    Singleton clusters score 0; noise excluded; null with fewer than two
    clusters."""
    stats, k = sized(cluster_stats(df, vec, label, dim))
    block = F.pmod(F.hash("cluster"), F.lit(-(-k // CLUSTER_BLOCK) or 1))
    blocks = stats.groupBy(block.alias("b")).agg(F.collect_list(F.struct(
        F.col("cluster").alias("c"), F.col("n").cast("double").alias("n"), "s", "q")).alias("cl"))
    pts = df.where(F.col(label) >= 0).select(F.monotonically_increasing_id().alias("p"), F.col(label).alias("own"),
                                             F.col(vec).cast("array<double>").alias("x"))
    x = F.col("x")
    xx = _dot(x, x)
    term = F.transform("cl", lambda c: F.struct(c["c"].alias("c"), c["n"].alias("n"),
                                                (c["n"] * xx - 2 * _dot(x, c["s"]) + c["q"]).alias("t")))
    met = pts.crossJoin(blocks).select("p", "own", term.alias("tot"))
    own = F.get(F.filter("tot", lambda e: e["c"] == F.col("own")), F.lit(0))
    others = F.transform(F.filter("tot", lambda e: e["c"] != F.col("own")), lambda e: e["t"] / e["n"])
    t = met.select("p", own["n"].alias("n_own"), own["t"].alias("t_own"), F.array_min(others).alias("b")) \
        .groupBy("p").agg(F.max("n_own").alias("n_own"), F.max("t_own").alias("t_own"), F.min("b").alias("b"))
    a = F.col("t_own") / (F.col("n_own") - 1)
    s = F.when(F.col("n_own") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0)))
    return t.agg(F.when(F.count("b") > 0, F.avg(s)).alias("silhouette"))


def clustering_metrics(df: DataFrame, vec: str, label: str, dim: int) -> DataFrame:
    """n_clusters (noise excluded), Davies-Bouldin and
    Calinski-Harabasz (Euclidean).  Centroid pairs are clusters², not rows²."""
    st = cluster_stats(df, vec, label, dim)
    cen = st.select("cluster", "n", F.transform("s", lambda v: v / F.col("n")).alias("mu"))
    pts = df.where(F.col(label) >= 0).select(F.col(label).alias("cluster"),
                                             F.col(vec).cast("array<double>").alias("x"))
    d2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0),
                                  lambda s, t: s + t)
    j = pts.join(cen, "cluster")
    per = j.groupBy("cluster").agg(F.avg(F.sqrt(d2(F.col("x"), F.col("mu")))).alias("s_i"),
                                   F.sum(d2(F.col("x"), F.col("mu"))).alias("w_i"),
                                   F.first("n").alias("n"), F.first("mu").alias("mu"))
    # centroid pairs: clusters² rows (k is a model size, not a data size)
    a, b = per.alias("a"), per.alias("b")
    pairs = a.crossJoin(b).where(F.col("a.cluster") != F.col("b.cluster")).select(
        F.col("a.cluster").alias("cluster"),
        ((F.col("a.s_i") + F.col("b.s_i")) / F.sqrt(d2(F.col("a.mu"), F.col("b.mu")))).alias("r"))
    db = pairs.groupBy("cluster").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    gm = per.agg(F.sum("n").alias("n_tot"), F.count("*").alias("k_tot"), F.sum("w_i").alias("w_tot"),
                 *[F.sum(F.col("mu")[i] * F.col("n")).alias(f"g{i}") for i in range(dim)])
    gm = gm.select("n_tot", "k_tot", "w_tot",
                   F.array(*[F.col(f"g{i}") / F.col("n_tot") for i in range(dim)]).alias("g"))
    bj = per.crossJoin(gm).agg(F.sum(F.col("n") * d2(F.col("mu"), F.col("g"))).alias("b_tot"),
                               F.first("n_tot").alias("n_tot"), F.first("k_tot").alias("k_tot"),
                               F.first("w_tot").alias("w_tot"))
    ch = F.when(F.col("w_tot") == 0, F.lit(1.0)).otherwise(
        F.col("b_tot") * (F.col("n_tot") - F.col("k_tot")) / (F.col("w_tot") * (F.col("k_tot") - 1)))
    res = bj.crossJoin(db).select(F.col("k_tot").cast("bigint").alias("n_clusters"),
                                  F.when(F.col("k_tot") >= 2, F.col("davies_bouldin")).alias("davies_bouldin"),
                                  F.when(F.col("k_tot") >= 2, ch).alias("calinski_harabasz"))
    return res


# -------------------------------------------------------------- anomaly set

def anomaly_metrics(df: DataFrame, pred: str, truth: str | None = None) -> DataFrame:
    """Anomaly count and ratio; precision/recall/F1 against truth."""
    p = F.col(pred) == 1
    aggs = [F.count_if(p).cast("double").alias("n_anomalies"),
            F.coalesce(F.try_divide(F.count_if(p).cast("double"), F.count("*").cast("double")),
                       F.lit(0.0)).alias("anomaly_ratio")]
    if truth:
        t = F.col(truth) == 1
        tp = F.count_if(p & t).cast("double")
        prec = F.coalesce(F.try_divide(tp, F.count_if(p).cast("double")), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp, F.count_if(t).cast("double")), F.lit(0.0))
        aggs += [prec.alias("precision"), rec.alias("recall")]
    out = df.agg(*aggs)
    if truth:
        out = out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                           F.col("precision") + F.col("recall")), F.lit(0.0)))
    return out


def score_histogram(df: DataFrame, score: str, bins: int = 40, threshold: float | None = None) -> DataFrame:
    """Score histogram over its range with the share above threshold."""
    st = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    j = df.crossJoin(F.broadcast(st)).withColumn("bin", hist_bin(score, "lo", "hi", bins))
    step = (F.col("hi") - F.col("lo")) / float(bins)
    g = j.groupBy("bin").agg(F.count("*").cast("bigint").alias("count"),
                             F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    out = g.select(F.col("bin").cast("bigint").alias("bin"), (F.col("lo") + F.col("bin") * step).alias("bin_lo"),
                   "count")
    if threshold is not None:
        out = out.withColumn("above_threshold", F.col("bin_lo") >= F.lit(threshold))
    return out


def cluster_centroids(df: DataFrame, vec: str, label: str, dim: int) -> DataFrame:
    """Mean vector and size per cluster label (noise included as −1)."""
    x = df.select(F.col(label).alias("cluster"), F.col(vec).cast("array<double>").alias("x"))
    g = x.groupBy("cluster").agg(F.count("*").cast("bigint").alias("n"),
                                 *[F.avg(F.col("x")[i]).alias(f"_m{i}") for i in range(dim)])
    return g.select("cluster", "n", F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("centroid"))


# ------------------------------------------------------- prediction summary

def prediction_summary_classes(df: DataFrame, pred: str) -> DataFrame:
    """A15 (classification / clustering): count and % of all rows per
    predicted class or cluster."""
    tot = df.agg(F.count("*").alias("n_all"))
    g = df.groupBy(F.col(pred).cast("string").alias("value")).agg(F.count("*").cast("bigint").alias("count"))
    return g.crossJoin(F.broadcast(tot)).select(
        "value", "count", (F.col("count") * 100.0 / F.col("n_all")).alias("percentage"))


def prediction_summary_values(df: DataFrame, pred: str) -> DataFrame:
    """A15 (regression): mean, sample std, min and max of the predictions."""
    x = F.col(pred).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def top_anomalies(df: DataFrame, score: str, id_col: str, n: int = 20) -> DataFrame:
    """O2: the n highest scores, ties by id (a top-k report:
    TakeOrderedAndProject keeps n rows per task)."""
    return df.orderBy(F.desc(score), F.col(id_col)).limit(n)
