"""Selected registered queries against their DuckDB twins on sf0.001."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from sparktab.sources.tables import TABLES

SF_SMALL = "/root/testdata/sf0.001"

NAMES = ["drift_report", "dataset_summary", "describe_numeric", "correlation", "split_stratified",
         "impute_median", "target_encode", "metrics_binary", "roc_curve", "silhouette_sq",
         "knn_classify", "dbscan", "monitor_latency_quantiles"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    got = sorted((tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == sorted(cols)
    idx = [dcols.index(c) for c in sorted(cols)]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 6
    assert "psi" in df.columns
