"""Training, validation, cross-validation and run records (M36-M38, L3,
S7, S10, E20, E21).  Fitting is MLlib's distributed training; evaluation
uses the aggregation-based metrics in :mod:`sparktab.operators.metrics`, so
predictions never leave the executors — only the one-row metric tables are
collected."""
from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.split import assign_folds
from ..session import written
from . import catalog as CAT


@dataclass
class TrainingResult:
    model_name: str
    task: str
    params: dict
    metrics: dict
    cv_mean: float | None = None
    cv_std: float | None = None
    train_seconds: float = 0.0
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    model: PipelineModel | None = None
    classes: list | None = None
    features: list | None = None


def label_indexer(label: str, out: str = "label") -> StringIndexer:
    """Alphabetical class order, as the reference's label encoding."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")


def supervised_pipeline(model: str, task: str, features: Sequence[str], label: str,
                        params: dict | None = None, n_rows: int | None = None,
                        label_std: float | None = None, n_classes: int | None = None) -> Pipeline:
    """Assembler + estimator.  Classification labels are indexed outside the
    pipeline (:func:`index_labels`), so a fitted pipeline scores frames that
    have no label column."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")]
    lab = "label" if task in CAT.CLASSIFICATION else label
    stages.append(CAT.make_estimator(model, task, params, n_rows, label_std, "features", lab, n_classes))
    return Pipeline(stages=stages)


def index_labels(train: DataFrame, label: str):
    """Alphabetical class index fitted on the training rows; rows whose class
    is unseen get no index (skipped) in training and evaluation frames."""
    idx = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc",
                        handleInvalid="skip").fit(train)
    return idx, list(idx.labels)


def score(fitted: PipelineModel, df: DataFrame, task: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Task-shaped prediction columns.  Classification: original
    class label, per-class probabilities and confidence (max probability,
    4 dp); regression: prediction; clustering: cluster id."""
    out = fitted.transform(df)
    if task in CAT.CLASSIFICATION:
        out = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=list(classes)).transform(out)
        if "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability")) \
                     .withColumn("confidence", F.round(F.array_max("probabilities"), 4))
        return out
    return out


def evaluate(pred: DataFrame, task: str, label: str, positive: str | None = None,
             classes: Sequence[str] | None = None) -> dict:
    """Validation metrics of a scored frame (one small collect).

    The positive class of a binary task is ``positive``, else the second of
    ``classes`` (the fitted label order), else "1"."""
    if positive is None:
        positive = str(classes[1]) if classes is not None and len(classes) == 2 else "1"
    if task in CAT.CLASSIFICATION:
        y = F.col(label).cast("string")
        p = pred.withColumn("_y", y).withColumn("_p", F.col("predicted_label"))
        binary = task == "binary_classification"
        m = M.classification_metrics(p, "_y", "_p", binary, positive).first().asDict()
        if binary and "probabilities" in p.columns:
            at = [str(c) for c in classes].index(positive) if classes is not None and positive in map(str, classes) else 1
            auc = M.roc_auc(p.withColumn("_pos", (F.col("_y") == positive).cast("double"))
                            .withColumn("_s", F.col("probabilities")[at]), "_pos", "_s").select("roc_auc").first()
            m["roc_auc"] = auc["roc_auc"]
        return m
    if task == "regression":
        return M.regression_metrics(pred, label, "prediction").first().asDict()
    raise ValueError(task)


def fold_scores(estimator, maps: Sequence[dict], folds: DataFrame, evaluator, k: int, parallelism: int = 2) -> np.ndarray:
    """Score of every parameter map (columns) on every held-out ``fold`` (rows) of a
    written table; nothing is cached beside it, and only models that are scored are fitted."""
    def one(i: int, m: dict) -> float:
        fitted = estimator.fit(folds.where(F.col("fold") != i), m)
        return float(evaluator.evaluate(fitted.transform(folds.where(F.col("fold") == i))))
    inherit = inheritable_thread_target(folds.sparkSession)
    tasks = [inherit(partial(one, i, m)) for i in range(k) for m in maps]
    with ThreadPool(min(parallelism, len(maps))) as pool:
        return np.reshape(pool.map(lambda task: task(), tasks, chunksize=1), (k, len(maps)))


def cross_validate(pipeline: Pipeline, df: DataFrame, task: str, label: str, key: str,
                   k: int = 5, parallelism: int = 2) -> tuple[float, float]:
    """K-fold score mean and population std (accuracy or R²); folds are
    seeded hash ranks (stratified for classification)."""
    folds = written(assign_folds(df, key, k, label if task in CAT.CLASSIFICATION else None), "folds")
    if task in CAT.CLASSIFICATION:
        folds = index_labels(folds, label)[0].transform(folds)
    if task in CAT.CLASSIFICATION:
        ev = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label")
    else:
        ev = RegressionEvaluator(metricName="r2", labelCol=label)
    scores = fold_scores(pipeline, [{}], folds, ev, k, parallelism)[:, 0]
    return float(scores.mean()), float(scores.std()) * ((k - 1) / k) ** 0.5


def train_model(train: DataFrame, val: DataFrame, model: str, task: str, features: Sequence[str],
                label: str, key: str, params: dict | None = None, cv_folds: int = 0) -> TrainingResult:
    """Fit on train, score validation, optional k-fold CV, timed."""
    p = {**CAT.defaults(model), **(params or {})}
    n_rows, label_std = None, None
    if model in ("logistic_regression", "svm_linear", "ridge", "elastic_net"):
        st = train.agg(F.count("*").alias("n"),
                       F.stddev_pop(F.col(label).cast("double")).alias("s")
                       if task == "regression" else F.lit(1.0).alias("s")).first()
        n_rows, label_std = st["n"], st["s"]
    classes = None
    fit_rows = train
    if task in CAT.CLASSIFICATION:
        idx, classes = index_labels(train, label)
        fit_rows = idx.transform(train)
    pipe = supervised_pipeline(model, task, features, label, p, n_rows, label_std, len(classes or ()))
    t0 = time.perf_counter()
    fitted = pipe.fit(fit_rows)
    secs = time.perf_counter() - t0
    metrics = evaluate(score(fitted, val, task, classes), task, label, classes=classes)
    res = TrainingResult(model, task, p, metrics, train_seconds=secs, model=fitted,
                         classes=classes, features=list(features))
    if cv_folds:
        res.cv_mean, res.cv_std = cross_validate(pipe, train, task, label, key, cv_folds)
    return res


def feature_importances(res: TrainingResult) -> list[tuple[str, float]]:
    """Tree importances by feature name (driver-side, d values)."""
    est = res.model.stages[-1]
    imp = getattr(est, "featureImportances", None)
    if imp is None:
        return []
    return sorted(zip(res.features, imp.toArray().tolist()), key=lambda t: -t[1])


# ------------------------------------------------------------------ records

RUN_SCHEMA = ("run_id string, model_name string, family string, task string, params map<string,string>, "
              "metrics map<string,double>, cv_mean double, cv_std double, train_seconds double, "
              "started_at timestamp, model_path string, status string")


def run_row(res: TrainingResult, model_path: str | None = None, status: str = "FINISHED") -> tuple:
    import datetime
    return (res.run_id, res.model_name, CAT.family(res.model_name), res.task,
            {k: str(v) for k, v in res.params.items()},
            {k: float(v) for k, v in res.metrics.items() if v is not None},
            res.cv_mean, res.cv_std, float(res.train_seconds),
            datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), model_path, status)


def append_runs(spark: SparkSession, path: str, results: Sequence[TrainingResult],
                model_paths: Sequence[str | None] | None = None) -> DataFrame:
    """Append run records to the ``runs`` table (Parquet, append mode)."""
    rows = [run_row(r, (model_paths or [None] * len(results))[i]) for i, r in enumerate(results)]
    df = spark.createDataFrame(rows, RUN_SCHEMA)
    df.write.mode("append").parquet(path)
    return df


def leaderboard(runs: DataFrame) -> DataFrame:
    """Per task, rank runs by the primary metric (missing → 0, higher
    first); anomaly runs keep submission order."""
    tasks = [t for t in CAT.TASKS]
    pk = F.coalesce(*[F.when(F.col("task") == t, F.col("metrics")[CAT.primary_metric(t)[0]])
                      for t in tasks])
    r = runs.withColumn("primary", F.coalesce(pk, F.lit(0.0)))
    w = Window.partitionBy("task").orderBy(
        F.when(F.col("task") == "anomaly_detection", F.lit(0.0)).otherwise(-F.col("primary")), "started_at", "run_id")
    return r.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)


def metric_table(val_metrics: DataFrame, test_metrics: DataFrame) -> DataFrame:
    """Metrics in long form (model, metric, value) for validation and
    test, pivoted to one column per source."""
    v = val_metrics.select("model_name", F.explode("metrics").alias("metric", "value")).withColumn("source", F.lit("validation"))
    t = test_metrics.select("model_name", F.explode("metrics").alias("metric", "value")).withColumn("source", F.lit("test"))
    return v.unionByName(t).groupBy("model_name", "metric").pivot("source", ["validation", "test"]).agg(F.first("value"))


def runs_history(runs: DataFrame, name_contains: str | None = None, status: str | None = None,
                 limit: int = 100) -> DataFrame:
    """Newest runs first, optional case-insensitive name filter."""
    r = runs
    if name_contains:
        r = r.where(F.lower("model_name").contains(name_contains.lower()))
    if status:
        r = r.where(F.col("status") == status)
    return r.orderBy(F.desc("started_at"), "run_id").limit(limit)


# ------------------------------------------------------------------ artifacts

def save_model(res: TrainingResult, path: str) -> str:
    """Fitted pipeline via MLWriter plus a metadata record (task, classes,
    features, metrics) written through Spark, so any shared filesystem works."""
    res.model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    meta = json.dumps({"model_name": res.model_name, "task": res.task, "classes": res.classes,
                       "features": res.features, "metrics": res.metrics, "params": res.params,
                       "run_id": res.run_id}, default=str)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(path + "_meta")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    meta = json.loads(spark.read.text(path + "_meta").first()["value"])
    return PipelineModel.load(path), meta
