"""Small exact frames after the reference's own unit tests."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.operators import kinds as K
from sparktab.operators import profile as P
from sparktab.operators.quantiles import exact_quantiles


def test_missing_counts(spark):
    df = spark.createDataFrame([(1.0, None, 1), (None, 2.0, 2), (3.0, None, 3), (4.0, 4.0, 4), (5.0, 5.0, 5)],
                               "a double, b double, c int")
    m = {r["column"]: r["missing_count"] for r in P.missing_values(df).collect()}
    assert m == {"a": 1, "b": 2, "c": 0}
    s = P.dataset_summary(df).first()
    assert s["total_missing"] == 3 and s["rows"] == 5 and s["columns"] == 3


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "a double")
    assert P.missing_values(df).first()["missing_count"] == 2


def test_correlation_minus_one_and_constant(spark):
    df = spark.createDataFrame([(1, 4, 1), (2, 3, 1), (3, 2, 1), (4, 1, 1)], "a int, b int, c int")
    r = {(x["col_a"], x["col_b"]): x["r"] for x in P.correlation(df).collect()}
    assert r[("a", "b")] == pytest.approx(-1.0)
    assert r[("a", "c")] is None and r[("c", "c")] is None


def test_class_balance_most_frequent_first(spark):
    df = spark.createDataFrame([(x,) for x in "AABBBC"], "target string")
    rows = P.class_balance(df, "target").collect()
    assert rows[0]["class"] == "B" and rows[0]["count"] == 3
    assert rows[0]["percentage"] == 50.0


def test_kinds_rules(spark):
    rows = [(i, f"c{i % 3}", f"text number {i}", f"2020-01-{(i % 28) + 1:02d}", dt.datetime(2020, 1, 1))
            for i in range(100)]
    df = spark.createDataFrame(rows, "n int, color string, desc string, d string, ts timestamp")
    k = K.kinds_map(df)
    assert k == {"n": "numerical", "color": "categorical", "desc": "text", "d": "datetime", "ts": "datetime"}


def test_all_null_string_is_datetime(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert K.kinds_map(df)["s"] == "datetime"


def test_task_inference(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (1, "c", 3.5)], "y int, s string, r double")
    t = lambda c: K.detect_task(df, c).first()["task"]
    assert t("y") == "binary_classification"
    assert t("s") == "multiclass_classification"
    assert K.detect_task(df, None).first()["task"] == "clustering"


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(size=n), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["p"]: r["q"] for r in exact_quantiles(df, ["x"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(v, p)), abs=1e-12)


def test_skewness_constant_and_small(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 10.0)], "c double, x double")
    s = {r["column"]: r["skew"] for r in P.skewness(df).collect()}
    assert s["c"] == 0.0
    x = np.array([1.0, 2.0, 10.0])
    m2, m3 = ((x - x.mean()) ** 2).mean(), ((x - x.mean()) ** 3).mean()
    g1 = m3 / m2 ** 1.5
    assert s["x"] == pytest.approx(g1 * math.sqrt(3 * 2) / 1)


def test_top_categories_ties_by_value(spark):
    df = spark.createDataFrame([(x,) for x in "bbaacd"], "v string")
    top = [(r["value"], r["count"]) for r in P.top_categories(df, ["v"], 3).orderBy("rank").collect()]
    assert top == [("a", 2), ("b", 2), ("c", 1)]


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = {r["bin"]: r["count"] for r in P.histogram(df, ["x"], 10).collect()}
    assert h[9] == 2 and sum(h.values()) == 11
