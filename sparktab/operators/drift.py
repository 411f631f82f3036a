"""Data drift between a reference and a current table.

All columns of one kind are unpivoted and tested in one job: the union of
both sides is pre-aggregated to one row per (column, value) with a count per
side (map-side partial aggregation, so the shuffle carries distinct values,
not rows), then every statistic is derived from that counts table.
Per-column results are a handful of rows, broadcast where joined."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rnd, hist_bin, unpivot_numeric, unpivot_string
from ..functions.stats import chi2_sf, ks_pvalue
from .running import running_sums, same_keys, sized

# PSI bands, test level, histogram size, smoothing constant and
# minimum sample size of the reference monitoring rules.
PSI_BINS = 10
PSI_NONE = 0.10
PSI_SLIGHT = 0.25
ALPHA = 0.05
EPS = 1e-8
MIN_VALUES = 5
LABEL_NONE, LABEL_SLIGHT, LABEL_SIGNIFICANT = "No drift", "Slight drift", "Significant drift"
COLOR_NONE, COLOR_SLIGHT, COLOR_SIGNIFICANT = "green", "orange", "red"
ERR_FEW = "Insufficient non-null values (<5)."
# scipy-compatible tolerance on observed vs expected totals in the chi² test
CHI2_RTOL = 1.4901161193847656e-08


def psi_label(psi) -> F.Column:
    """Traffic-light label of a PSI value."""
    p = F.col(psi) if isinstance(psi, str) else psi
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when(p < PSI_NONE, LABEL_NONE).when(p < PSI_SLIGHT, LABEL_SLIGHT)
            .otherwise(LABEL_SIGNIFICANT))


def psi_color(psi) -> F.Column:
    p = F.col(psi) if isinstance(psi, str) else psi
    return (F.when(p.isNull(), F.lit(None).cast("string"))
            .when(p < PSI_NONE, COLOR_NONE).when(p < PSI_SLIGHT, COLOR_SLIGHT)
            .otherwise(COLOR_SIGNIFICANT))


def _names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(c, i) for i, c in enumerate(columns)],
                                 "column string, ordinal int")


def with_sides(df: DataFrame, is_current) -> DataFrame:
    """One-table form: ``_side`` = 1 where ``is_current`` holds, else 0.
    Passing the result as ``ref`` with ``cur=None`` scans the table once."""
    return df.withColumn("_side", F.when(is_current, F.lit(1)).otherwise(F.lit(0)))


def value_counts_two_sided(ref: DataFrame, cur: DataFrame | None, columns: Sequence[str],
                           numeric: bool) -> DataFrame:
    """(column, value, a, b): per-value counts in reference (a) and current
    (b).  Numeric: nulls and NaN dropped.  Categorical: a null value keeps
    its group with zero counts so it still counts as an observed category.
    ``cur=None``: ``ref`` carries a ``_side`` column (see :func:`with_sides`)."""
    unp = unpivot_numeric if numeric else unpivot_string
    if cur is None:
        long = unp(ref, columns, ids=["_side"])
    else:
        long = (unp(ref, columns).withColumn("_side", F.lit(0))
                .unionByName(unp(cur, columns).withColumn("_side", F.lit(1))))
    v = F.col("value")
    if numeric:
        long = long.where(v.isNotNull() & ~F.isnan(v))
        present = F.lit(True)
    else:
        present = v.isNotNull()
    return long.groupBy("column", "value").agg(
        F.count_if((F.col("_side") == 0) & present).alias("a"),
        F.count_if((F.col("_side") == 1) & present).alias("b"))


def drift_numeric(ref: DataFrame, cur: DataFrame | None, columns: Sequence[str],
                  bins: int = PSI_BINS, min_values: int = MIN_VALUES) -> DataFrame:
    """D1 + D2: KS statistic and p-value, PSI over ``bins`` equal-width bins
    of the combined range (additive eps smoothing), label and verdict.

    Plan: value counts → running sums over range parts, joined with totals and
    range per column → ``groupBy(column, bin)`` → ``groupBy(column)``.  Empty
    bins enter PSI in closed form."""
    counts, n_counts = sized(value_counts_two_sided(ref, cur, columns, numeric=True))
    stats = counts.groupBy("column").agg(
        F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur"),
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = running_sums(counts, ["column"], "value", ["a", "b"], n_rows=n_counts).join(stats, "column")
    gap = F.abs(F.try_divide(F.col("cum_a"), F.col("n_ref")) - F.try_divide(F.col("cum_b"), F.col("n_cur")))
    per_bin = (x.withColumn("bin", hist_bin("value", "lo", "hi", bins))
               .groupBy("column", "bin").agg(
                   F.max(gap).alias("d"), F.sum("a").alias("a"), F.sum("b").alias("b"),
                   F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"),
                   F.first("lo").alias("lo"), F.first("hi").alias("hi")))
    r = (F.col("a") + EPS) / (F.col("n_ref") + EPS * bins)
    c = (F.col("b") + EPS) / (F.col("n_cur") + EPS * bins)
    per_col = per_bin.groupBy("column").agg(
        F.max("d").alias("ks_d"), F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.sum((c - r) * F.log(c / r)).alias("psi_present"), F.count("*").alias("n_bins"))
    r0 = F.lit(EPS) / (F.col("n_ref") + EPS * bins)
    c0 = F.lit(EPS) / (F.col("n_cur") + EPS * bins)
    empty = (F.lit(bins) - F.col("n_bins")) * (c0 - r0) * F.log(c0 / r0)
    psi = per_col.select("column", "ks_d", "n_ref", "n_cur",
                         F.when(F.col("lo") == F.col("hi"), F.lit(0.0))
                         .otherwise(F.col("psi_present") + empty).alias("psi_raw"))

    base = (F.broadcast(_names(ref, columns)).join(psi, "column", "left")
            .fillna(0, ["n_ref", "n_cur"]))
    few = (F.col("n_ref") < min_values) | (F.col("n_cur") < min_values)
    p_raw = ks_pvalue("ks_d", "n_ref", "n_cur")
    ok = lambda e: F.when(few, F.lit(None)).otherwise(e)
    return base.select(
        "ordinal", "column", F.lit("numerical").alias("kind"),
        F.col("n_ref").cast("bigint").alias("n_ref"), F.col("n_cur").cast("bigint").alias("n_cur"),
        ok(rnd("ks_d", 4)).cast("double").alias("ks_statistic"),
        ok(rnd(p_raw, 4)).cast("double").alias("ks_pvalue"),
        ok(rnd("psi_raw", 4)).cast("double").alias("psi"),
        ok(psi_label("psi_raw")).alias("drift_label"),
        ok(psi_color("psi_raw")).alias("drift_color"),
        ok((F.col("psi_raw") >= PSI_NONE) | (p_raw < ALPHA)).cast("boolean").alias("drifted"),
        F.when(few, F.lit(ERR_FEW)).alias("error"))


def _with_totals(rows: DataFrame, group: Sequence[str], *totals) -> DataFrame:
    """Every row with aggregates of its group."""
    if not group:
        return rows.crossJoin(rows.agg(*totals))  # one row
    agg = rows.groupBy(*group).agg(*totals)
    names = [c for c in agg.columns if c not in group]
    return rows.alias("r").join(agg.alias("t"), same_keys("r", "t", group)).select(
        *[F.col(f"r.{c}").alias(c) for c in rows.columns], *names)


def psi_from_counts(counts: DataFrame, group: Sequence[str] = ("column",),
                    smoothing: str = "replace", eps: float = EPS) -> DataFrame:
    """PSI over category counts (a = reference, b = current) with one of the
    three smoothings: ``replace`` (missing count → eps, then normalise),
    ``additive`` ((n+eps)/(N+eps·k)), ``floor`` (shares floored at eps
    inside the log only).  Totals are aggregates joined back, so no task
    holds all categories of a column."""
    group = list(group)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    if smoothing == "replace":
        ra = F.when(a > 0, a).otherwise(F.lit(eps))
        rb = F.when(b > 0, b).otherwise(F.lit(eps))
        t = counts.select(*group, ra.alias("ra"), rb.alias("rb"))
        t = _with_totals(t, group, F.sum("ra").alias("tot_ra"), F.sum("rb").alias("tot_rb"))
        r, c = F.col("ra") / F.col("tot_ra"), F.col("rb") / F.col("tot_rb")
        return t.groupBy(*group).agg(F.sum((c - r) * F.log(c / r)).alias("psi_raw"))
    t = _with_totals(counts.select(*group, a.alias("a"), b.alias("b")), group, F.sum("a").alias("tot_a"),
                     F.sum("b").alias("tot_b"), F.count("*").alias("n_cat"))
    if smoothing == "additive":
        r = (F.col("a") + eps) / (F.col("tot_a") + eps * F.col("n_cat"))
        c = (F.col("b") + eps) / (F.col("tot_b") + eps * F.col("n_cat"))
        return t.groupBy(*group).agg(F.sum((c - r) * F.log(c / r)).alias("psi_raw"))
    if smoothing == "floor":
        r = F.try_divide(F.col("a"), F.col("tot_a"))
        c = F.try_divide(F.col("b"), F.col("tot_b"))
        return t.groupBy(*group).agg(F.sum((c - r) * F.log(
            F.greatest(c, F.lit(eps)) / F.greatest(r, F.lit(eps)))).alias("psi_raw"))
    raise ValueError(f"unknown smoothing {smoothing!r}")


def chi2_from_counts(counts: DataFrame, group: Sequence[str] = ("column",)) -> DataFrame:
    """Goodness of fit of current counts (b) against reference shares (a)
    scaled to the current total.  Null when fewer than two reference
    categories, an empty side, or a current category unseen in the
    reference (observed and expected totals disagree)."""
    group = list(group)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    j = _with_totals(counts.select(*group, a.alias("a"), b.alias("b")), group, F.sum("a").alias("NA"),
                     F.sum("b").alias("NB"))
    e = F.col("a") / F.col("NA") * F.col("NB")
    pos = F.col("a") > 0
    agg = j.groupBy(*group).agg(
        F.first("NA").alias("NA"), F.first("NB").alias("NB"),
        F.count_if(pos).alias("k"),
        F.sum(F.when(pos, F.col("b"))).alias("obs"),
        F.sum(F.when(pos, e)).alias("exp"),
        F.sum(F.when(pos, (F.col("b") - e) * (F.col("b") - e) / e)).alias("stat"))
    valid = ((F.col("NA") > 0) & (F.col("NB") > 0) & (F.col("k") >= 2)
             & (F.abs(F.col("obs") - F.col("exp"))
                <= F.lit(CHI2_RTOL) * F.greatest(F.col("obs"), F.col("exp"))))
    return agg.select(*group, F.col("NA").alias("n_ref"), F.col("NB").alias("n_cur"),
                      F.when(valid, F.col("stat")).alias("chi2_raw"),
                      F.when(valid, chi2_sf(F.col("stat"), F.col("k") - 1)).alias("chi2_p_raw"))


def drift_categorical(ref: DataFrame, cur: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """D3 + D4: categorical PSI (replacement smoothing) and chi² test."""
    counts, _ = sized(value_counts_two_sided(ref, cur, columns, numeric=False))
    psi = psi_from_counts(counts, smoothing="replace")
    chi = chi2_from_counts(counts)
    base = (F.broadcast(_names(ref, columns)).join(chi, "column", "left").join(psi, "column", "left")
            .fillna(0, ["n_ref", "n_cur"]))
    return base.select(
        "ordinal", "column", F.lit("categorical").alias("kind"),
        F.col("n_ref").cast("bigint").alias("n_ref"), F.col("n_cur").cast("bigint").alias("n_cur"),
        rnd("chi2_raw", 4).cast("double").alias("chi2_statistic"),
        rnd("chi2_p_raw", 4).cast("double").alias("chi2_pvalue"),
        rnd(F.coalesce("psi_raw", F.lit(0.0)), 4).alias("psi"),
        psi_label(F.coalesce("psi_raw", F.lit(0.0))).alias("drift_label"),
        psi_color(F.coalesce("psi_raw", F.lit(0.0))).alias("drift_color"),
        ((F.coalesce("psi_raw", F.lit(0.0)) >= PSI_NONE)
         | F.coalesce(F.col("chi2_p_raw") < ALPHA, F.lit(False))).alias("drifted"),
        F.lit(None).cast("string").alias("error"))


REPORT_COLUMNS = ["column", "kind", "n_ref", "n_cur", "ks_statistic", "ks_pvalue",
                  "chi2_statistic", "chi2_pvalue", "psi", "drift_label", "drift_color",
                  "drifted", "error"]


def detect_drift(ref: DataFrame, cur: DataFrame | None, kinds: Mapping[str, str],
                 feature_columns: Sequence[str]) -> DataFrame:
    """Numerical → KS + PSI, categorical → chi² + PSI, other kinds and
    columns absent from either side skipped.  One job per kind."""
    cur_cols = ref.columns if cur is None else cur.columns
    cols = [c for c in feature_columns if c in ref.columns and c in cur_cols]
    num = [c for c in cols if kinds.get(c) == "numerical"]
    cat = [c for c in cols if kinds.get(c) == "categorical"]
    parts = []
    if num:
        parts.append(drift_numeric(ref, cur, num))
    if cat:
        parts.append(drift_categorical(ref, cur, cat))
    if not parts:
        raise ValueError("no numerical or categorical feature columns to test")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c in REPORT_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.select(*REPORT_COLUMNS)


def drift_summary(report: DataFrame) -> DataFrame:
    """Tested, drifted, rate (3 dp), max PSI and drifted names."""
    valid = F.col("error").isNull()
    return report.agg(
        F.count("*").cast("bigint").alias("total_columns"),
        F.count_if(valid).cast("bigint").alias("tested_columns"),
        F.count_if(valid & F.col("drifted")).cast("bigint").alias("drifted_columns"),
        F.coalesce(rnd(F.try_divide(F.count_if(valid & F.col("drifted")).cast("double"),
                                        F.count_if(valid).cast("double")), 3),
                   F.lit(0.0)).alias("drift_rate"),
        F.coalesce(F.max(F.when(valid, F.col("psi"))), F.lit(0.0)).alias("max_psi"),
        F.concat_ws(",", F.array_sort(F.collect_list(
            F.when(valid & F.col("drifted"), F.col("column"))))).alias("drifted_column_names"))


def overlay_numeric(ref: DataFrame, cur: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Normalised histograms of reference and current over the combined
    range, one row per bin with both shares (full outer alignment)."""
    counts = value_counts_two_sided(ref, cur, [column], numeric=True)
    st = counts.agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                    F.sum("a").alias("na"), F.sum("b").alias("nb"))
    j = counts.crossJoin(F.broadcast(st)).withColumn("bin", hist_bin("value", "lo", "hi", bins))
    g = j.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"),
                             F.first("na").alias("na"), F.first("nb").alias("nb"),
                             F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / float(bins)
    return g.select(F.col("bin").cast("bigint").alias("bin"),
                    rnd(F.col("lo") + F.col("bin") * step, 6).alias("bin_lo"),
                    rnd(F.try_divide(F.col("a"), F.col("na")), 6).alias("ref_share"),
                    rnd(F.try_divide(F.col("b"), F.col("nb")), 6).alias("cur_share"))


def overlay_categorical(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """Category shares side by side; a category missing on one side
    gets share 0 (full outer join on the category, null-safe)."""
    def shares(df, name):
        g = df.groupBy(F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
        tot = df.agg(F.count("*").alias("n_all"))
        return g.crossJoin(F.broadcast(tot)).select(
            "category", rnd(F.try_divide(F.col("n"), F.col("n_all")), 6).alias(name))
    r, c = shares(ref, "ref_share"), shares(cur, "cur_share")
    j = r.join(c, r["category"].eqNullSafe(c["category"]), "full_outer")
    return j.select(F.coalesce(r["category"], c["category"]).alias("category"),
                    F.coalesce("ref_share", F.lit(0.0)).alias("ref_share"),
                    F.coalesce("cur_share", F.lit(0.0)).alias("cur_share"))


# ------------------------------------------------------- prediction drift

VERDICT_NONE, VERDICT_POSSIBLE, VERDICT_SIGNIFICANT = "none", "possible", "significant"


def verdict(psi, p) -> F.Column:
    """Three-level verdict: none when PSI < .10 and p ≥ .05; possible when
    PSI < .25 or p ≥ .05; else significant."""
    psi = F.col(psi) if isinstance(psi, str) else psi
    p = F.col(p) if isinstance(p, str) else p
    return (F.when((psi < PSI_NONE) & (p >= ALPHA), VERDICT_NONE)
            .when((psi < PSI_SLIGHT) | (p >= ALPHA), VERDICT_POSSIBLE).otherwise(VERDICT_SIGNIFICANT))


def _class_counts(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    r = ref.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("a"))
    c = cur.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("b"))
    j = r.join(c, r["value"].eqNullSafe(c["value"]), "full_outer")
    return j.select(F.lit(column).alias("column"), F.coalesce(r["value"], c["value"]).alias("value"),
                    F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def concept_drift_categorical(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """D8 (categorical predictions): PSI with additive eps smoothing, χ²
    (0 and 1 when the test is undefined), verdict."""
    counts, _ = sized(_class_counts(ref, cur, column))
    psi = psi_from_counts(counts, smoothing="additive")
    chi = chi2_from_counts(counts)
    j = psi.join(chi, "column")
    stat = F.coalesce("chi2_raw", F.lit(0.0))
    p = F.coalesce("chi2_p_raw", F.lit(1.0))
    return j.select("column", rnd(stat, 4).alias("statistic"), rnd(p, 4).alias("p_value"),
                    rnd("psi_raw", 4).alias("psi"), verdict("psi_raw", p).alias("verdict"))


def concept_drift_numeric(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """D8 (numerical predictions): KS + PSI (D1/D2) and the verdict."""
    d = drift_numeric(ref, cur, [column])
    return d.select("column", F.col("ks_statistic").alias("statistic"), F.col("ks_pvalue").alias("p_value"),
                    "psi", verdict("psi", "ks_pvalue").alias("verdict"))


def cluster_share_drift(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """Cluster shares over all labels; χ² of current counts against
    reference shares (0 and 1 with fewer than two expected clusters); PSI
    with shares floored at 1e-9 inside the log only; verdict."""
    counts, _ = sized(_class_counts(ref, cur, column))
    psi = psi_from_counts(counts, smoothing="floor", eps=1e-9)
    chi = chi2_from_counts(counts)
    k = counts.groupBy("column").agg(F.count_if(F.col("a") > 0).alias("k_ref"),
                                     F.count_if(F.col("b") > 0).alias("n_clusters_cur"))
    j = psi.join(chi, "column").join(k, "column")
    stat = F.when(F.col("k_ref") < 2, F.lit(0.0)).otherwise(F.col("chi2_raw"))
    p = F.when(F.col("k_ref") < 2, F.lit(1.0)).otherwise(F.col("chi2_p_raw"))
    return j.select("column", rnd(stat, 4).alias("chi2_statistic"), rnd(p, 4).alias("chi2_pvalue"),
                    rnd("psi_raw", 4).alias("psi"), F.col("n_clusters_cur").cast("bigint").alias("n_clusters"),
                    verdict("psi_raw", F.coalesce(p, F.lit(0.0))).alias("verdict"))


def boundary_outliers(ref: DataFrame, cur: DataFrame, vec: str, label: str, dim: int,
                      q: float = 0.95, warn_rate: float = 0.10) -> DataFrame:
    """Centroid per training cluster; threshold = q-quantile of the
    training distances to the own centroid; current rows farther than the
    threshold (or in a cluster unknown to training) are boundary outliers."""
    from .metrics import cluster_centroids
    from .quantiles import fitted_quantiles
    cen = cluster_centroids(ref, vec, label, dim).select(F.col("cluster").alias(label), "centroid")
    d2 = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0),
                                  lambda s, t: s + t)
    dist = lambda df: df.select(F.col(vec).cast("array<double>").alias("_x"), label).join(
        cen, label, "left").select(
        F.coalesce(F.sqrt(d2(F.col("_x"), F.col("centroid"))), F.lit(float("inf"))).alias("dist"))
    thr = fitted_quantiles(dist(ref), ["dist"], [q])["dist"][0]
    d = dist(cur)
    return d.agg(F.lit(thr).alias("threshold"),
                 F.count_if(F.col("dist") > F.lit(thr)).cast("bigint").alias("n_outside"),
                 F.count("*").cast("bigint").alias("n")).select(
        rnd("threshold", 6).alias("threshold"), "n_outside",
        rnd(F.try_divide(F.col("n_outside").cast("double"), F.col("n").cast("double")), 6).alias("rate"),
        (F.try_divide(F.col("n_outside").cast("double"), F.col("n").cast("double")) > warn_rate).alias("warn"))
