"""Model catalogue: the reference's model families and defaults mapped onto
MLlib estimators (or the distributed algorithms in this package).

Penalty conversions keep the optimum of the reference's objective:
logistic regression C → regParam = 1/(C·n) without standardisation; lasso
alpha → regParam = alpha; ridge alpha → regParam = alpha·σ_y/n on the normal
solver; elastic net (alpha, l1_ratio) → λ1 = alpha·l1_ratio,
λ2 = alpha·(1−l1_ratio)·σ_y, regParam = λ1+λ2, elasticNetParam = λ1/(λ1+λ2)."""
from __future__ import annotations

from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import Binarizer

from .boosting import BoostedTreesEstimator
from .cell_trees import CellTrees

SEED = 42

CLASSIFICATION = {"binary_classification", "multiclass_classification"}
TASKS = CLASSIFICATION | {"regression", "clustering", "anomaly_detection", "dimensionality_reduction"}

# Default hyper-parameters of the reference's model families.
DEFAULTS: dict[str, dict[str, Any]] = {
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_split": 5,
                      "min_samples_leaf": 2, "max_features": "sqrt"},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8,
                "colsample_bytree": 0.8, "min_child_weight": 3},
    "gradient_boosting": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.8},
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "naive_bayes_gaussian": {},
    "naive_bayes_bernoulli": {"alpha": 1.0},
    "svm_linear": {"C": 1.0, "max_iter": 2000},
    "decision_tree": {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "knn": {"n_neighbors": 5, "weights": "uniform"},
    "linear_regression": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0},
    "elastic_net": {"alpha": 1.0, "l1_ratio": 0.5},
    "kmeans": {"n_clusters": 8},
    "gaussian_mixture": {"n_components": 8, "covariance_type": "full"},
    "agglomerative": {"n_clusters": 8, "linkage": "ward"},
    "dbscan": {"eps": 0.5, "min_samples": 5},
    "isolation_forest": {"n_estimators": 100, "contamination": "auto", "max_features": 1.0},
    "local_outlier_factor": {"n_neighbors": 20, "contamination": "auto"},
    "elliptic_envelope": {"contamination": 0.1},
    "one_class_svm": {"nu": 0.1},
    "pca": {"n_components": 2},
    "truncated_svd": {"n_components": 2},
}
ALIASES = {"lof": "local_outlier_factor"}
MAX_TREE_DEPTH = 30  # MLlib's limit stands in for an unbounded depth


def defaults(model: str) -> dict[str, Any]:
    return dict(DEFAULTS.get(ALIASES.get(model, model), {}))


def family(model: str) -> str:
    """Model-family tag used in run records."""
    m = ALIASES.get(model, model)
    if m in ("random_forest", "xgboost", "gradient_boosting", "decision_tree", "isolation_forest"):
        return "tree"
    if m in ("logistic_regression", "linear_regression", "ridge", "lasso", "elastic_net", "svm_linear"):
        return "linear"
    if m in ("knn", "local_outlier_factor", "dbscan"):
        return "neighbors"
    if m in ("kmeans", "gaussian_mixture", "agglomerative", "mean_shift"):
        return "clustering"
    if m in ("pca", "truncated_svd"):
        return "reduction"
    return "other"


def make_estimator(model: str, task: str, params: dict | None = None, n_rows: int | None = None,
                   label_std: float | None = None, features: str = "features", label: str = "label",
                   n_classes: int | None = None):
    """Unfitted MLlib estimator (or Pipeline) for a supervised or MLlib-native
    unsupervised model; ``n_rows`` / ``label_std`` are needed by the linear
    penalty conversions."""
    model = ALIASES.get(model, model)
    p = {**defaults(model), **(params or {})}
    io = {"featuresCol": features}
    sup = {**io, "labelCol": label}
    if model == "random_forest":
        kw = dict(numTrees=int(p["n_estimators"]), maxDepth=min(int(p["max_depth"] or MAX_TREE_DEPTH), MAX_TREE_DEPTH),
                  minInstancesPerNode=int(max(p["min_samples_leaf"], 1)), featureSubsetStrategy=str(p["max_features"]),
                  seed=SEED, **sup)
        return CellTrees(C.RandomForestClassifier(**kw) if task in CLASSIFICATION else R.RandomForestRegressor(**kw))
    if model == "xgboost":
        unknown = set(p) - {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree", "min_child_weight",
                            "gamma", "reg_alpha", "reg_lambda", "seed"}
        if unknown:
            raise ValueError(f"parameters without effect on {model}: {sorted(unknown)}")
        if task == "multiclass_classification" and not n_classes:
            raise ValueError("the number of classes is needed")
        objective = {"regression": "squared", "binary_classification": "logistic"}.get(task, "softmax")
        return BoostedTreesEstimator(objective=objective, classes=int(n_classes or 2), featuresCol=features, labelCol=label,
                                     params={"seed": SEED, **p})
    if model == "gradient_boosting":
        kw = dict(maxIter=int(p["n_estimators"]), maxDepth=int(p["max_depth"]), stepSize=float(p["learning_rate"]),
                  subsamplingRate=float(p["subsample"]), seed=SEED, **sup)
        if task == "regression":
            return CellTrees(R.GBTRegressor(**kw))
        if task == "binary_classification":
            return C.GBTClassifier(**kw)
        return C.OneVsRest(classifier=C.GBTClassifier(**{k: v for k, v in kw.items() if k not in ("labelCol",)}),
                           parallelism=4, **sup)
    if model == "decision_tree":
        kw = dict(maxDepth=min(int(p["max_depth"] or MAX_TREE_DEPTH), MAX_TREE_DEPTH),
                  minInstancesPerNode=int(max(p["min_samples_leaf"], 1)), seed=SEED, **sup)
        return C.DecisionTreeClassifier(**kw) if task in CLASSIFICATION else R.DecisionTreeRegressor(**kw)
    if model == "logistic_regression":
        n = max(int(n_rows or 1), 1)
        return C.LogisticRegression(regParam=1.0 / (float(p["C"]) * n), elasticNetParam=0.0,
                                    standardization=False, maxIter=int(p["max_iter"]),
                                    family="multinomial" if task == "multiclass_classification" else "auto", **sup)
    if model == "naive_bayes_gaussian":
        return C.NaiveBayes(modelType="gaussian", **sup)
    if model == "naive_bayes_bernoulli":
        return Pipeline(stages=[Binarizer(threshold=0.0, inputCol=features, outputCol="_bin"),
                                C.NaiveBayes(modelType="bernoulli", smoothing=float(p["alpha"]),
                                             featuresCol="_bin", labelCol=label)])
    if model == "svm_linear":
        n = max(int(n_rows or 1), 1)
        svc = C.LinearSVC(regParam=1.0 / (float(p["C"]) * n), maxIter=int(p["max_iter"]),
                          standardization=False, **sup)
        return svc if task == "binary_classification" else C.OneVsRest(classifier=svc, parallelism=4, **sup)
    if model == "linear_regression":
        return R.LinearRegression(regParam=0.0, solver="normal", **sup)
    if model == "ridge":
        n = max(int(n_rows or 1), 1)
        return R.LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False,
                                  regParam=float(p["alpha"]) * float(label_std or 1.0) / n, **sup)
    if model == "lasso":
        return R.LinearRegression(elasticNetParam=1.0, regParam=float(p["alpha"]), standardization=False, **sup)
    if model == "elastic_net":
        l1 = float(p["alpha"]) * float(p["l1_ratio"])
        l2 = float(p["alpha"]) * (1 - float(p["l1_ratio"])) * float(label_std or 1.0)
        return R.LinearRegression(regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 > 0 else 0.0,
                                  standardization=False, **sup)
    if model == "kmeans":
        return K.KMeans(k=int(p["n_clusters"]), seed=SEED, **io)
    if model == "gaussian_mixture":
        if p.get("covariance_type", "full") != "full":
            raise ValueError("only full covariance matrices are supported by GaussianMixture")
        return K.GaussianMixture(k=int(p["n_components"]), seed=SEED, **io)
    if model == "agglomerative":
        raise ValueError("agglomerative clustering is operators.hierarchy.agglomerate, not an estimator")
    raise ValueError(f"unknown or non-MLlib model {model!r} for task {task!r}")


def primary_metric(task: str) -> tuple[str, bool]:
    """(metric, higher is better) used to rank runs and judge retraining."""
    return {"binary_classification": ("f1", True), "multiclass_classification": ("f1", True),
            "regression": ("r2", True), "clustering": ("silhouette", True),
            "anomaly_detection": ("anomaly_ratio", False),
            "dimensionality_reduction": ("explained_variance", True)}[task]
