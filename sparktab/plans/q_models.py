"""Model queries (rows-only checks): each fits on the hash split's train
rows of a driver table and returns metrics computed by Spark on the held-out
rows, so the answer is derived from the tables end to end."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import round_all
from ..models import anomaly as AN
from ..models import reduction as RD
from ..models import train as TR
from ..models.catalog import make_estimator
from ..operators import metrics as M
from ..operators.hierarchy import agglomerate
from ..operators import split as S
from ..session import written
from ..sources.tables import table
from .fixtures import vector_dim
from .fixtures import LI_KEY
from .registry import query

LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem(spark, sf, binary=False):
    """Split line items: the key and what the fits read, written once as every pass of a fit reads them."""
    li = table(spark, sf, "lineitem").select(LI_KEY().alias("k"), *LI_FEATS, "l_returnflag")
    if binary:
        li = li.withColumn("is_returned", (F.col("l_returnflag") == "R").cast("int").cast("string"))
    return written(S.assign_split(li, "k"), "split-lineitem")


def _classify(model, binary=False, params=None):
    def run(spark, sf):
        d = _lineitem(spark, sf, binary)
        label = "is_returned" if binary else "l_returnflag"
        task = "binary_classification" if binary else "multiclass_classification"
        tr, te = d.where("split = 'train'"), d.where("split = 'test'")
        res = TR.train_model(tr, d.where("split = 'val'"), model, task, LI_FEATS, label, "k", params)
        scored = TR.score(res.model, te, task, res.classes).withColumn("_y", F.col(label).cast("string"))
        m = M.classification_metrics(scored, "_y", "predicted_label", binary, "1")
        return round_all(m.withColumn("model", F.lit(model)), 6)
    return run


for _m in ["random_forest", "decision_tree", "logistic_regression", "naive_bayes_gaussian"]:
    query(f"train_{_m}_multiclass")(_classify(_m))
for _m in ["svm_linear", "naive_bayes_bernoulli", "logistic_regression"]:
    query(f"train_{_m}_binary")(_classify(_m, True))
# a level of a round is a job, so the default hundred rounds are for larger tables
query("train_xgboost_multiclass")(_classify("xgboost", params={"n_estimators": 10, "max_depth": 4}))
query("train_xgboost_binary")(_classify("xgboost", True, {"n_estimators": 10, "max_depth": 4}))


def _regress(model):
    def run(spark, sf):
        d = _lineitem(spark, sf)
        feats = ["l_quantity", "l_discount", "l_tax"]
        tr, te = d.where("split = 'train'"), d.where("split = 'test'")
        res = TR.train_model(tr, d.where("split = 'val'"), model, "regression", feats, "l_extendedprice", "k")
        scored = TR.score(res.model, te, "regression")
        return round_all(M.regression_metrics(scored, "l_extendedprice", "prediction")
                         .withColumn("model", F.lit(model)), 6)
    return run


for _m in ["linear_regression", "ridge", "lasso", "elastic_net", "gradient_boosting", "random_forest", "decision_tree"]:
    query(f"train_{_m}_regression")(_regress(_m))


@query("cross_validation_logistic")
def cross_validation_logistic(spark, sf):
    d = _lineitem(spark, sf).where("split = 'train'")
    pipe = TR.supervised_pipeline("logistic_regression", "multiclass_classification", LI_FEATS, "l_returnflag",
                                  n_rows=d.count())
    mean, std = TR.cross_validate(pipe, d, "multiclass_classification", "l_returnflag", "k", 5)
    return d.agg(F.count("*").alias("rows")).select(F.lit(mean).alias("cv_mean"), F.lit(std).alias("cv_std"), "rows")


@query("feature_importance_rf")
def feature_importance_rf(spark, sf):
    d = _lineitem(spark, sf)
    res = TR.train_model(d.where("split = 'train'"), d.where("split = 'val'"), "random_forest",
                         "multiclass_classification", LI_FEATS, "l_returnflag", "k")
    imp = TR.feature_importances(res)
    return spark.createDataFrame(imp, "feature string, importance double").orderBy(F.desc("importance")).limit(30)


def _embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    from pyspark.ml.functions import array_to_vector
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"),
                    array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _part_points(spark, sf):
    from pyspark.ml.functions import array_to_vector
    p = table(spark, sf, "part")
    x = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100.0)
    return p.select(F.col("p_partkey").alias("vec_id"), x.alias("x"), array_to_vector(x).alias("features"))


def _cluster(model, source="embeddings"):
    def run(spark, sf):
        e = _embeddings(spark, sf) if source == "embeddings" else _part_points(spark, sf)
        if model == "agglomerative":
            pred = e.join(agglomerate(e, 10, "ward", "vec_id", "x"), "vec_id")
        else:
            fitted = make_estimator(model, "clustering", {"n_clusters": 10, "n_components": 10}).fit(e)
            pred = fitted.transform(e).withColumn("cluster", F.col("prediction").cast("int"))
        dim = vector_dim(e, "x")
        out = M.clustering_metrics(pred, "x", "cluster", dim).crossJoin(M.silhouette_sq(pred, "x", "cluster", dim))
        return round_all(out.withColumn("model", F.lit(model)), 6)
    return run


for _m in ["kmeans", "agglomerative"]:
    query(f"cluster_{_m}")(_cluster(_m))
# MLlib's mixture fit needs well-conditioned covariances: the 2-d part table
query("cluster_gaussian_mixture")(_cluster("gaussian_mixture", "part"))


@query("anomaly_isolation_forest")
def anomaly_isolation_forest(spark, sf):
    c = table(spark, sf, "customer")
    m = AN.isolation_forest(c, ["c_acctbal", "c_nationkey"], "c_custkey", 100)
    scored = m.transform(c)
    return round_all(M.anomaly_metrics(scored, "is_anomaly").crossJoin(
        scored.agg(F.max("anomaly_score").alias("max_score"), F.min("anomaly_score").alias("min_score"))), 6)


@query("anomaly_elliptic_envelope")
def anomaly_elliptic_envelope(spark, sf):
    p = table(spark, sf, "part")
    feats = ["p_size", "p_retailprice"]
    mu, prec, thr = AN.elliptic_envelope(p, feats, 0.1)
    scored = AN.score_elliptic(p, feats, mu, prec, thr)
    return round_all(M.anomaly_metrics(scored, "is_anomaly"), 6)


@query("anomaly_kernel_novelty")
def anomaly_kernel_novelty(spark, sf):
    p = table(spark, sf, "part")
    feats = ["p_size", "p_retailprice"]
    params = AN.kernel_novelty(p, feats, 0.1)
    return round_all(M.anomaly_metrics(AN.score_novelty(p, feats, params), "is_anomaly"), 6)


@query("reduce_pca")
def reduce_pca(spark, sf):
    li = table(spark, sf, "lineitem")
    proj = RD.pca(li, LI_FEATS, 2)
    out = proj.transform(li.select(*LI_FEATS))
    return round_all(out.agg(F.count("*").alias("rows"), F.var_samp("pc1").alias("var_pc1"),
                             F.var_samp("pc2").alias("var_pc2"), F.corr("pc1", "pc2").alias("corr_pc12"))
                     .crossJoin(proj.variance_table(spark).agg(F.sum("ratio").alias("explained_variance"))), 6)


@query("reduce_svd_reconstruction")
def reduce_svd_reconstruction(spark, sf):
    li = table(spark, sf, "lineitem")
    proj = RD.truncated_svd(li, LI_FEATS, 2)
    z = proj.inverse_transform(proj.transform(li.select(*LI_FEATS)))
    err = sum((F.col(c) - F.col(f"{c}_hat")) ** 2 for c in LI_FEATS)
    return round_all(z.agg(F.avg(err).alias("mse_reconstruction"), F.count("*").alias("rows"))
                     .crossJoin(proj.variance_table(spark).agg(F.sum("ratio").alias("explained_variance"))), 6)


@query("pca_components_for_variance")
def pca_components_for_variance(spark, sf):
    proj = RD.pca(table(spark, sf, "lineitem"), LI_FEATS, 4)
    return RD.components_for_variance(proj.variance_table(spark), 0.95)


# ------------------------------------------------------------ further models
from ..models import extra as EX  # noqa: E402


@query("kmeans_scan_elbow")
def kmeans_scan_elbow(spark, sf):
    scan = EX.kmeans_scan(_embeddings(spark, sf), "x", range(2, 11))
    return round_all(scan.crossJoin(EX.elbow(scan)), 6)


@query("random_search_logistic")
def random_search_logistic(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    d = _lineitem(spark, sf).where("split = 'train'")
    d = StringIndexer(inputCol="l_returnflag", outputCol="label", stringOrderType="alphabetAsc").fit(d).transform(d)
    lr = LogisticRegression(maxIter=50)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=LI_FEATS, outputCol="features"), lr])
    best, trials = EX.random_search(pipe, lr, {"regParam": (1e-4, 1.0, "log"), "elasticNetParam": (0.0, 1.0)},
                                    d, "multiclass_classification", "k", "l_returnflag", n_trials=4, folds=3)
    return round_all(trials.withColumn("best_params", F.lit(str(best))), 6)


@query("linear_attribution_top")
def linear_attribution_top(spark, sf):
    d = _lineitem(spark, sf)
    feats = ["l_quantity", "l_discount", "l_tax"]
    res = TR.train_model(d.where("split = 'train'"), d.where("split = 'val'"), "linear_regression", "regression",
                         feats, "l_extendedprice", "k")
    coefs = res.model.stages[-1].coefficients.toArray().tolist()
    attr = EX.linear_attribution(d.where("split = 'test'"), feats, coefs, "k")
    return round_all(EX.mean_abs_attribution(attr, 15), 6)


@query("learning_curve")
def learning_curve(spark, sf):
    d = _lineitem(spark, sf).where("split <> 'test'")
    return round_all(EX.learning_curve(d, "k", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 6)


@query("lda_projection")
def lda_projection(spark, sf):
    li = table(spark, sf, "lineitem")
    V, ratio, mu = EX.fisher_lda(li, LI_FEATS, "l_returnflag")
    rows = [(i + 1, float(r), [float(v) for v in V[i]]) for i, r in enumerate(ratio)]
    comps = spark.createDataFrame(rows, "component int, ratio double, weights array<double>")
    proj = li.select(*[sum(F.col(c) * float(V[k][i]) for i, c in enumerate(LI_FEATS)).alias(f"ld{k + 1}")
                       for k in range(len(ratio))])
    return round_all(comps.crossJoin(proj.agg(F.count("*").alias("rows"), F.var_samp("ld1").alias("var_ld1"))), 6)


@query("cca_single_target")
def cca_single_target(spark, sf):
    feats = ["l_quantity", "l_discount", "l_tax"]
    a, rho, load = EX.cca_single_target(table(spark, sf, "lineitem"), feats, "l_extendedprice")
    li = table(spark, sf, "lineitem")
    u = sum(F.col(c) * float(a[i]) for i, c in enumerate(feats))
    return round_all(li.agg(F.corr(u, F.col("l_extendedprice")).alias("canonical_corr"))
                     .withColumn("rho_from_moments", F.lit(rho))
                     .withColumn("loadings", F.array(*[F.lit(float(v)) for v in load])), 6)


@query("nmf_factorise")
def nmf_factorise(spark, sf):
    p = table(spark, sf, "part")
    feats = ["p_size", "p_retailprice"]
    W, H, rmse = EX.nmf(p, feats, "p_partkey", k=2, max_iter=20)
    new = EX.nmf_transform(p.select("p_partkey", *feats), feats, H, 50)
    recon = sum((F.greatest(F.col(c).cast("double"), F.lit(0.0))
                 - (F.col("nmf")[0] * float(H[0, i]) + F.col("nmf")[1] * float(H[1, i]))) ** 2
                for i, c in enumerate(feats))
    return round_all(new.agg(F.sqrt(F.avg(recon / len(feats))).alias("rmse_fixed_h"), F.count("*").alias("rows"))
                     .withColumn("rmse_als", F.lit(rmse)).withColumn("row_factors", F.lit(W.count())), 4)


@query("mean_shift_clusters")
def mean_shift_clusters(spark, sf):
    pts = _part_points(spark, sf)
    lab, centers = EX.mean_shift(pts, "x", "vec_id", bandwidth=5.0)
    return lab.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("n_centers", F.lit(centers.count()))


@query("calibrated_linear_svc")
def calibrated_linear_svc(spark, sf):
    d = _lineitem(spark, sf).withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    tr, te = d.where("split = 'train'"), d.where("split = 'test'")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    svc, cal = EX.platt_calibrated_svc(tr, LI_FEATS, "y", "k")
    s = svc.transform(VectorAssembler(inputCols=LI_FEATS, outputCol="features").transform(te))
    s = s.withColumn("margin", vector_to_array("rawPrediction")[1])
    p = cal.transform(VectorAssembler(inputCols=["margin"], outputCol="mv").transform(s.drop("probability", "prediction", "rawPrediction")))
    return round_all(p.agg(F.avg(vector_to_array("probability")[1]).alias("mean_prob"),
                           F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy")), 6)


@query("kernel_svm_classifier")
def kernel_svm_classifier(spark, sf):
    from pyspark.ml.functions import array_to_vector
    d = _lineitem(spark, sf).withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    m, params = EX.kernel_classifier(d.where("split = 'train'"), LI_FEATS, "y", 50)
    z, _ = AN.fourier_features(d.where("split = 'test'"), LI_FEATS, 50, params["gamma"])
    pred = m.transform(z.withColumn("features", array_to_vector("rff")))
    return round_all(M.classification_metrics(pred.withColumn("yy", F.col("y").cast("int").cast("string"))
                                              .withColumn("pp", F.col("prediction").cast("int").cast("string")),
                                              "yy", "pp", True, "1"), 6)


@query("kernel_svr_regressor")
def kernel_svr_regressor(spark, sf):
    from pyspark.ml.functions import array_to_vector
    d = _lineitem(spark, sf)
    feats = ["l_quantity", "l_discount", "l_tax"]
    m, params = EX.kernel_regressor(d.where("split = 'train'"), feats, "l_extendedprice", 50)
    z, _ = AN.fourier_features(d.where("split = 'test'"), feats, 50, params["gamma"])
    pred = m.transform(z.withColumn("features", array_to_vector("rff")))
    return round_all(M.regression_metrics(pred, "l_extendedprice", "prediction"), 6)


@query("pca_top_loadings")
def pca_top_loadings(spark, sf):
    proj = RD.pca(table(spark, sf, "lineitem"), LI_FEATS, 4)
    return round_all(RD.top_loadings(proj, spark, 10, 5), 6)


@query("pca_cumulative_variance")
def pca_cumulative_variance(spark, sf):
    proj = RD.pca(table(spark, sf, "lineitem"), LI_FEATS, 4)
    return round_all(proj.variance_table(spark), 6)


@query("cluster_centroids_2d")
def cluster_centroids_2d(spark, sf):
    """K-means centres projected on the first two principal axes."""
    e = _embeddings(spark, sf)
    from pyspark.ml.clustering import KMeans
    m = KMeans(k=10, seed=42).fit(e)
    dim = vector_dim(e, "x")
    cols = [F.col("x")[i].alias(f"f{i}") for i in range(dim)]
    flat = e.select(*cols)
    proj = RD.pca(flat, [f"f{i}" for i in range(dim)], 2)
    centers = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(m.clusterCenters())],
                                    ", ".join(["cluster int"] + [f"f{i} double" for i in range(dim)]))
    return round_all(proj.transform(centers).select("cluster", "pc1", "pc2"), 6)


@query("tree_shapley_top")
def tree_shapley_top(spark, sf):
    """M40 + O5: Monte-Carlo Shapley values of a random-forest regressor on
    the test rows, features by mean |value|."""
    d = _lineitem(spark, sf)
    feats = ["l_quantity", "l_discount", "l_tax"]
    tr = d.where("split = 'train'")
    res = TR.train_model(tr, d.where("split = 'val'"), "random_forest", "regression", feats, "l_extendedprice", "k",
                         {"n_estimators": 20})
    base = tr.agg(*[F.avg(c).alias(c) for c in feats]).first().asDict()
    attr = EX.mc_shapley(res.model, d.where("split = 'test'"), feats, "k", base, n_perm=4)
    return round_all(EX.mean_abs_attribution(attr.withColumnRenamed("attribution", "attribution"), 15), 6)


@query("metric_table_val_test")
def metric_table_val_test(spark, sf):
    """Validation vs test metrics per model (long form pivoted)."""
    d = _lineitem(spark, sf)
    feats = ["l_quantity", "l_discount", "l_tax"]
    rows_v, rows_t = [], []
    for m in ("linear_regression", "lasso"):
        res = TR.train_model(d.where("split = 'train'"), d.where("split = 'val'"), m, "regression", feats,
                             "l_extendedprice", "k")
        test = TR.evaluate(TR.score(res.model, d.where("split = 'test'"), "regression"), "regression", "l_extendedprice")
        rows_v.append((m, {k: float(v) for k, v in res.metrics.items()}))
        rows_t.append((m, {k: float(v) for k, v in test.items()}))
    sch = "model_name string, metrics map<string,double>"
    return round_all(TR.metric_table(spark.createDataFrame(rows_v, sch), spark.createDataFrame(rows_t, sch)), 6)


# ---------------------------------------- exact single-feature linear fits
def _single_fit(model):
    def run(spark, sf):
        li = table(spark, sf, "lineitem")
        res = TR.train_model(li, li, model, "regression", ["l_quantity"], "l_extendedprice", "l_orderkey")
        lm = res.model.stages[-1]
        return round_all(li.agg(F.count("*").alias("n")).select(
            F.lit(float(lm.coefficients[0])).alias("slope"), F.lit(float(lm.intercept)).alias("intercept")), 4)
    return run


query("ols_single_feature", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")(_single_fit("linear_regression"))
query("ridge_single_feature", """WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy,
  var_pop(l_quantity) * count(*) AS sxx, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)
SELECT round(sxy / (sxx + 1.0), 4) AS slope, round(my - sxy / (sxx + 1.0) * mx, 4) AS intercept FROM m""")(_single_fit("ridge"))
query("lasso_single_feature", """WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v,
  avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem),
w AS (SELECT sign(c) * greatest(abs(c) - 1.0, 0.0) / v AS w, my, mx FROM m)
SELECT round(w, 4) AS slope, round(my - w * mx, 4) AS intercept FROM w""")(_single_fit("lasso"))
query("elastic_net_single_feature", """WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v,
  avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem),
w AS (SELECT sign(c) * greatest(abs(c) - 0.5, 0.0) / (v + 0.5) AS w, my, mx FROM m)
SELECT round(w, 4) AS slope, round(my - w * mx, 4) AS intercept FROM w""")(_single_fit("elastic_net"))


def _gnb_sql():
    from .q_prep import split_sql
    f = LI_FEATS
    var_eps = "greatest(" + ", ".join(f"var_samp({c})" for c in f) + ") * 1e-9"
    stats = ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + (SELECT e FROM eps) AS v_{c}" for c in f)
    ll = " + ".join(f"-0.5 * (ln(2 * pi() * v_{c}) + (te.{c} - m_{c}) * (te.{c} - m_{c}) / v_{c})" for c in f)
    return f"""WITH li AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem), sp AS ({split_sql('li', 'k')}),
tr AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split = 'test'),
eps AS (SELECT {var_eps} AS e FROM tr),
st AS (SELECT l_returnflag AS cls, ln(count(*) / (SELECT count(*) FROM tr)) AS lp, {stats} FROM tr GROUP BY 1),
sc AS (SELECT te.k, st.cls, st.lp + {ll} AS s FROM te, st)
SELECT k, arg_max(cls, s) AS prediction FROM sc GROUP BY k"""


@query("naive_bayes_gaussian_predictions", _gnb_sql())
def naive_bayes_gaussian_predictions(spark, sf):
    d = _lineitem(spark, sf)
    res = TR.train_model(d.where("split = 'train'"), d.where("split = 'val'"), "naive_bayes_gaussian",
                         "multiclass_classification", LI_FEATS, "l_returnflag", "k")
    out = TR.score(res.model, d.where("split = 'test'"), "multiclass_classification", res.classes)
    return out.select("k", F.col("predicted_label").alias("prediction"))
