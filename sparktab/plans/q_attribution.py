"""Exact tree attribution: a stump against SQL, a forest whose attributions add up, and a ranking."""
from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..models import attribution as AT
from ..models import boosting as B
from ..models.cell_trees import CellTrees
from ..sources.tables import table
from .q_boosting import PARTS, _stump_sql
from .registry import query


@query("tree_attribution_stump", "SELECT id, 'p_size' AS feature, round(margin - avg(margin) OVER (), 6) AS attribution FROM ("
       + _stump_sql(PARTS, "avg(y)", "b.base - y", "1.0", 5, 0.5, 2.0, 0.3) + ")")
def tree_attribution_stump(spark, sf):
    """One split of one feature: its value is what the margin differs from the mean margin."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("p_size"),
                                        F.col("p_retailprice").cast("double").alias("y"))
    rows = p.select("id", F.array("p_size").alias("x"), "y")
    model = B.fit(rows, "squared", 1, B.Params(n_estimators=1, max_depth=1, min_child_weight=5, reg_alpha=0.5, reg_lambda=2.0))
    out = AT.tree_attributions(p, AT.boosted_paths(model, rows), ["p_size"], "id")
    return out.select("id", "feature", rnd(F.col("attribution"), 6).alias("attribution"))


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _line_forest(spark, sf):
    """(lines with their prediction, paths) of a forest for the price."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id")
    rows = table(spark, sf, "lineitem").select(key, *[F.col(c).cast("double").alias(c) for c in LINE_FEATURES],
                                               F.col("l_extendedprice").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=LINE_FEATURES, outputCol="features").transform(rows)
    model = CellTrees(RandomForestRegressor(numTrees=10, maxDepth=6, seed=42)).fit(rows)
    return model.transform(rows), AT.mllib_paths(model, len(LINE_FEATURES))


@query("tree_attribution_sums", "SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n, 0.0 AS gap FROM lineitem GROUP BY 1")
def tree_attribution_sums(spark, sf):
    """For every id, the sum of its lines' attributions less (prediction - expectation): nothing."""
    rows, paths = _line_forest(spark, sf)
    sums = AT.tree_attributions(rows, paths, "features", "id").groupBy("id").agg(F.sum("attribution").alias("s"))
    beyond = F.col("prediction") - F.lit(float(paths.expectation()[0]))
    lines = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(beyond).alias("beyond"))
    return lines.join(sums, "id").select("id", "n", rnd(F.abs(F.col("s") - F.col("beyond")), 4).alias("gap"))


@query("tree_attribution_top")
def tree_attribution_top(spark, sf):
    """Features of the same forest by mean |attribution| over all lines."""
    rows, paths = _line_forest(spark, sf)
    top = AT.attribution_ranking(AT.tree_attributions(rows, paths, LINE_FEATURES, "id"))
    return top.select("feature", rnd(F.col("mean_abs"), 4).alias("mean_abs"))
