import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparktab.operators import clean as C
from sparktab.operators import prep as PR
from sparktab.operators import split as S


def test_datetime_parts(spark):
    rows = [(dt.datetime(2020, 1, 6), 1), (dt.datetime(2021, 6, 15), 2), (dt.datetime(2022, 12, 31), 3)]
    df = spark.createDataFrame(rows, "dt timestamp, val int")
    out = PR.datetime_parts(df, ["dt"]).orderBy("val").collect()
    assert [r["dt_year"] for r in out] == [2020, 2021, 2022]
    assert [r["dt_month"] for r in out] == [1, 6, 12]
    assert out[0]["dt_dayofweek"] == 0  # Monday
    assert "dt" not in PR.datetime_parts(df, ["dt"]).columns


def test_unparseable_text_date_is_null(spark):
    df = spark.createDataFrame([("2020-01-01",), ("garbage",)], "d string")
    out = PR.datetime_parts(df, ["d"]).collect()
    assert out[0]["d_year"] == 2020 and out[1]["d_year"] is None


def test_imputers_leave_no_nulls(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (3.0, "b")], "x double, c string")
    for strat in ("mean", "median", "most_frequent", "constant"):
        fills = PR.fit_imputer(df, ["x", "c"] if strat in ("most_frequent", "constant") else ["x"], strat)
        out = PR.apply_imputer(df, fills)
        assert out.where(F.col("x").isNull()).count() == 0
    assert PR.fit_imputer(df, ["x"], "median")["x"] == 3.0
    assert PR.fit_imputer(df, ["c"], "most_frequent")["c"] == "b"


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,)], "x double")
    assert PR.fit_imputer(df, ["x"], "most_frequent")["x"] == 1.0


def test_scalers_constant_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    for kind in ("standard", "minmax", "robust"):
        out = PR.apply_scaler(df, PR.fit_scaler(df, ["x", "c"], kind)).collect()
        assert all(r["c"] == 0.0 for r in out)
    st = PR.apply_scaler(df, PR.fit_scaler(df, ["x"], "standard")).collect()
    assert st[0]["x"] == pytest.approx(-1.224744871391589)


def test_onehot_unknown_all_zero(spark):
    tr = spark.createDataFrame([("b",), ("a",)], "c string")
    te = spark.createDataFrame([("z",), (None,), ("a",)], "c string")
    cats = PR.fit_onehot(tr, ["c"])
    assert cats == {"c": ["a", "b"]}
    out = PR.apply_onehot(te, cats).collect()
    assert [(r["c_a"], r["c_b"]) for r in out] == [(0.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_ordinal_unknown_minus_one(spark):
    tr = spark.createDataFrame([("b",), ("a",)], "c string")
    te = spark.createDataFrame([("z",), ("b",)], "c string")
    out = PR.apply_ordinal(te, PR.category_levels(tr, ["c"]), ["c"]).collect()
    assert sorted(r["c"] for r in out) == [-1.0, 1.0]


def test_polynomial_order(spark):
    assert PR.polynomial_terms(2, 2) == [(0,), (1,), (0, 0), (0, 1), (1, 1)]
    assert PR.polynomial_terms(2, 2, True) == [(0,), (1,), (0, 1)]


def test_split_sizes_and_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = S.assign_split(df, "k")
    sizes = {r["split"]: r["rows"] for r in S.split_sizes(a).collect()}
    assert sizes == {"test": 200, "val": 100, "train": 700}
    b = S.assign_split(df.repartition(7), "k")
    assert a.join(b, ["k", "split"]).count() == 1000


def test_stratified_split_keeps_proportions(spark):
    df = spark.createDataFrame([(i, "A" if i < 60 else "B") for i in range(100)], "k int, y string")
    s = S.assign_split(df, "k", "y", stratify=True)
    got = {(r["y"], r["split"]): r["n"] for r in s.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert got[("A", "test")] == 12 and got[("B", "test")] == 8


def test_folds_cover_all_rows(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    f = S.assign_folds(df, "k", 5)
    counts = sorted(r["n"] for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert sum(counts) == 103 and counts[-1] - counts[0] <= 1


def test_drop_and_regex(spark):
    df = spark.createDataFrame([(1, "1-A"), (2, None), (3, "9-B")], "k int, s string")
    assert C.drop_missing_rows(df, ["s"]).count() == 2
    assert C.regex_report(df, {"s": "[1-3]-"}).first()["non_matching"] == 2


def test_low_variance_population(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 0.1), (1.0, 0.2)], "c double, x double")
    rep = {r["column"]: r["dropped"] for r in C.low_variance_report(df, ["c", "x"], 0.005).collect()}
    assert rep == {"c": True, "x": False}


def test_unsupported_extension_raises(spark):
    from sparktab.sources.tables import load_dataset
    with pytest.raises(ValueError, match="xlsx"):
        load_dataset(spark, "/root/testdata/sf0.001/events.xlsx")


def test_validate_rows_errors(spark):
    df = spark.createDataFrame([("1.5", 1.0), ("n/a", 2.0), (None, None)], "num string, req double")
    out = C.validate_rows(df, ["num"], ["req"]).collect()
    assert [len(r["errors"]) for r in out] == [0, 1, 1]
    assert out[1]["errors"] == ["num: not a number"] and out[2]["errors"] == ["req: missing value"]


def test_improved_expr_matches_rule(spark):
    from sparktab.models.retrain import improved, improved_expr
    rows = [(None, 0.5), (0.5, 0.6), (0.6, 0.6), (0.1, None)]
    df = spark.createDataFrame(rows, "old double, new double")
    got = [r[0] for r in df.select(improved_expr("old", "new", "regression")).collect()]
    assert got == [improved(o, n, "regression") for o, n in rows]
