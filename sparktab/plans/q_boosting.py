"""Second-order boosting: one round of depth one, whose twins try every split in SQL, and whole fits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..models import boosting as B
from ..sources.tables import table
from .registry import query


def _stump_sql(rows: str, base: str, g: str, h: str, weight: int, alpha: float, lam: float, rate: float) -> str:
    """The best split of one feature among all its values, and both sides' weights."""
    def t(x):
        return f"(sign({x}) * greatest(abs({x}) - {alpha}, 0))"
    return f"""WITH r AS ({rows}), b AS (SELECT {base} AS base FROM r),
v AS (SELECT x, sum({g}) AS g, sum({h}) AS h FROM r, b GROUP BY x),
c AS (SELECT x, sum(g) OVER (ORDER BY x) AS gl, sum(h) OVER (ORDER BY x) AS hl, sum(g) OVER () AS gt, sum(h) OVER () AS ht FROM v),
s AS (SELECT *, {t('gl')} ** 2 / (hl + {lam}) + {t('(gt - gl)')} ** 2 / (ht - hl + {lam}) - {t('gt')} ** 2 / (ht + {lam}) AS gain
  FROM c WHERE hl >= {weight} AND ht - hl >= {weight}),
best AS (SELECT * FROM s ORDER BY gain DESC, x LIMIT 1)
SELECT r.id, b.base - {rate} * CASE WHEN r.x <= best.x THEN {t('gl')} / (hl + {lam}) ELSE {t('(gt - gl)')} / (ht - hl + {lam}) END AS margin
FROM r, b, best"""


def _margins(rows, model):
    """(id, margin) of rows (id, x)."""
    def run(batches):
        import numpy as np
        import pandas as pd
        for b in batches:
            x = np.stack(b["x"].to_numpy()).astype(float) if len(b) else np.zeros((0, model.n_features))
            yield pd.DataFrame({"id": b["id"], "margin": model.margins(x)[:, 0]})
    return rows.select("id", "x").mapInPandas(run, "id long, margin double").select(
        "id", rnd(F.col("margin"), 6).alias("margin"))


PARTS = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part"


@query("boost_stump_squared", "SELECT id, round(margin, 6) AS margin FROM (" + _stump_sql(
    PARTS, "avg(y)", "b.base - y", "1.0", 5, 0.5, 2.0, 0.3) + ")")
def boost_stump_squared(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("x"),
                                        F.col("p_retailprice").cast("double").alias("y"))
    params = B.Params(n_estimators=1, max_depth=1, min_child_weight=5, reg_alpha=0.5, reg_lambda=2.0)
    return _margins(p, B.fit(p, "squared", 1, params))


LINES = """SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS x,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem"""


@query("boost_stump_logistic", "SELECT id, round(margin, 6) AS margin FROM (" + _stump_sql(
    LINES, "ln(avg(y) / (1 - avg(y)))", "1 / (1 + exp(-b.base)) - y",
    "1 / (1 + exp(-b.base)) * (1 - 1 / (1 + exp(-b.base)))", 20, 0.0, 1.0, 0.1) + ")")
def boost_stump_logistic(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"),
        F.array(F.col("l_quantity").cast("double")).alias("x"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    params = B.Params(n_estimators=1, max_depth=1, learning_rate=0.1, min_child_weight=20)
    return _margins(rows, B.fit(rows, "logistic", 1, params))


@query("boost_softmax_embeddings")
def boost_softmax_embeddings(spark, sf):
    """Ten classes, three rounds of depth three with sampled rows and columns: accuracy on the training rows."""
    e = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    params = B.Params(n_estimators=3, max_depth=3, subsample=0.8, colsample_bytree=0.8)
    model = B.fit(e, "softmax", 64, params, classes=10)

    def run(batches):
        import numpy as np
        import pandas as pd
        for b in batches:
            p = model.outputs(np.stack(b["x"].to_numpy()).astype(float))
            yield pd.DataFrame({"label": b["y"].astype("int64"), "prediction": p.argmax(1)})
    return e.mapInPandas(run, "label long, prediction long").groupBy("label", "prediction").agg(F.count("*").alias("n"))
