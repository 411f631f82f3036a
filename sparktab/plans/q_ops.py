"""Operational queries: retraining cycle over stored splits, registry,
history, run leaderboard and validated scoring (rows-only checks).  All
scratch tables live under the session's shared checkpoint folder."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..models import retrain as RT
from ..models import train as TR
from ..operators import clean as C
from ..operators import drift as D
from ..operators import split as S
from ..session import scratch_path, written
from ..sources import store
from ..sources.tables import table
from .fixtures import LI_KEY
from .registry import query

FEATS = ["l_quantity", "l_discount", "l_tax"]


def _splits(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", LI_KEY())
    li = li.select("k", *FEATS, "l_extendedprice", "l_returnflag")
    return written(S.assign_split(li, "k"), "split-lineitem")


@query("retraining_cycle")
def retraining_cycle(spark, sf):
    base = scratch_path(spark, f"retrain-{uuid.uuid4().hex[:8]}")
    store.save_splits(_splits(spark, sf), f"{base}/splits")
    for _ in range(2):  # first run registers v1, second compares against it
        RT.run_retraining(spark, f"{base}/splits", f"{base}/registry", f"{base}/history", f"{base}/models",
                          "price_model", "linear_regression", "regression", FEATS, "l_extendedprice", "k")
    return store.history(spark, f"{base}/history").select("model_name", "metric_name", "old_metric", "new_metric",
                                                          "improved", "promoted_version")


@query("active_model_version")
def active_model_version(spark, sf):
    base = scratch_path(spark, f"registry-{uuid.uuid4().hex[:8]}")
    d = _splits(spark, sf)
    tr, va = d.where("split = 'train'"), d.where("split = 'val'")
    for m in ("linear_regression", "ridge"):
        res = TR.train_model(tr, va, m, "regression", FEATS, "l_extendedprice", "k")
        path = TR.save_model(res, f"{base}/models/{res.run_id}")
        store.register_model(spark, f"{base}/registry", "price_model", res.run_id, path, res.metrics["r2"])
    return store.active_model(spark, f"{base}/registry", "price_model").select("version")


@query("run_leaderboard")
def run_leaderboard(spark, sf):
    base = scratch_path(spark, f"runs-{uuid.uuid4().hex[:8]}")
    d = _splits(spark, sf)
    tr, va = d.where("split = 'train'"), d.where("split = 'val'")
    results = [TR.train_model(tr, va, m, "regression", FEATS, "l_extendedprice", "k")
               for m in ("linear_regression", "lasso", "decision_tree")]
    TR.append_runs(spark, f"{base}/runs", results)
    runs = spark.read.parquet(f"{base}/runs")
    board = TR.leaderboard(runs).select("model_name", "family", "rank", "is_best", F.col("metrics")["r2"].alias("r2"))
    return board.join(TR.runs_history(runs, "reg").select("model_name").withColumn("matched", F.lit(True)),
                      "model_name", "left")


@query("validated_scoring")
def validated_scoring(spark, sf):
    """C4: validate raw records, score the good ones, count the quarantine."""
    o = table(spark, sf, "orders")
    raw = o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.lit("n/a"))
                   .otherwise(F.col("o_totalprice").cast("string")).alias("price_text"), "o_orderstatus")
    v = C.validate_rows(raw, ["price_text"])
    good = v.where(F.size("errors") == 0).withColumn("price", F.col("price_text").cast("double"))
    res = TR.train_model(good, good, "logistic_regression", "multiclass_classification", ["price"],
                         "o_orderstatus", "o_orderkey")
    scored = TR.score(res.model, good.drop("o_orderstatus"), "multiclass_classification", res.classes)
    path = scratch_path(spark, f"predictions-{uuid.uuid4().hex[:8]}")
    store.write_predictions(scored.drop("features", "rawPrediction", "probability", "errors"), path)  # S9
    scored = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    out = scored.groupBy("predicted_label").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
    bad = v.where(F.size("errors") > 0).agg(F.count("*").alias("quarantined"))
    return out.crossJoin(bad)


@query("retrain_advice")
def retrain_advice(spark, sf):
    from .q_drift import drift_report
    return RT.retrain_advice(D.drift_summary(drift_report(spark, sf)))
