"""Retraining cycle (X1, X2, X5): load splits, score the active model on
test, fit a candidate, score it, compare, save and promote if improved,
append to the history table — one batch job over shared storage."""
from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from . import catalog as CAT
from . import train as TR

ANOMALY_TOLERANCE = 0.05  # fixed value: anomaly-ratio change still counted as improved


def improved(old: float | None, new: float | None, task: str) -> bool:
    """No old metric → improved; anomaly → |Δ| < .05 or lower ratio;
    otherwise strictly higher."""
    if old is None:
        return True
    if new is None:
        return False
    if task == "anomaly_detection":
        return abs(new - old) < ANOMALY_TOLERANCE or new < old
    return new > old


def improved_expr(old, new, task: str) -> F.Column:
    """X2 as a column expression over joined old/new metric rows."""
    o, n = F.col(old), F.col(new)
    if task == "anomaly_detection":
        rule = (F.abs(n - o) < ANOMALY_TOLERANCE) | (n < o)
    else:
        rule = n > o
    return F.when(o.isNull(), F.lit(True)).when(n.isNull(), F.lit(False)).otherwise(rule)


def run_retraining(spark: SparkSession, splits_path: str, registry_path: str, history_path: str,
                   models_path: str, name: str, model: str, task: str, features: Sequence[str],
                   label: str, key: str, params: dict | None = None) -> DataFrame:
    tr = store.load_split(spark, splits_path, "train")
    va = store.load_split(spark, splits_path, "val")
    te = store.load_split(spark, splits_path, "test")
    metric, _ = CAT.primary_metric(task)
    old_metric = None
    if store._exists(spark, registry_path):
        act = store.active_model(spark, registry_path, name).first()
        if act and act["model_path"]:
            fitted, meta = TR.load_model(spark, act["model_path"])
            old_metric = TR.evaluate(TR.score(fitted, te, task, meta.get("classes")), task, label, classes=meta.get("classes")).get(metric)
    res = TR.train_model(tr, va, model, task, features, label, key, params)
    new_metric = TR.evaluate(TR.score(res.model, te, task, res.classes), task, label, classes=res.classes).get(metric)
    ok = improved(old_metric, new_metric, task)
    version = None
    if ok:
        path = f"{models_path}/{name}/{res.run_id}"
        TR.save_model(res, path)
        version = store.register_model(spark, registry_path, name, res.run_id, path, new_metric)
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    return store.append_history(spark, history_path, (now, name, task, metric, old_metric, new_metric,
                                                      ok, version, res.run_id))


def retrain_advice(summary: DataFrame) -> DataFrame:
    """Advise retraining when any tested column drifted."""
    return summary.select("drift_rate", "drifted_column_names",
                          (F.col("drift_rate") > 0).alias("retrain_advised"))
