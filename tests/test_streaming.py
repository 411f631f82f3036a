"""Streaming twins: the same operators under Structured Streaming agree with
their batch runs."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sparktab.sources.tables import table
from sparktab.streaming import monitor as MO
from sparktab.streaming import stream as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="sparktab-stream-")


def _events_as_files(spark, scratch):
    ev = table(spark, SF, "events")
    src = os.path.join(scratch, "src")
    ev.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(src)
    return ev, src


def test_windowed_psi_stream_matches_batch(spark, scratch):
    ev, src = _events_as_files(spark, scratch)
    cut = F.lit("2024-01-08").cast("timestamp_ntz")
    ref = ev.where(F.col("ts") < cut)
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 3).parquet(src)
              .where(F.col("ts") >= cut))
    sink = os.path.join(scratch, "psi")
    q = ST.start_windowed_psi_stream(ref, stream, "value", sink, os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    got = {r["window_start"]: r["psi"] for r in spark.read.parquet(sink).collect()}
    want = {r["window_start"]: r["psi"] for r in ST.windowed_psi(ref, ev.where(F.col("ts") >= cut), "value").collect()}
    assert len(got) >= len(want) - 1          # the last window is still open at the watermark
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=1e-12)


def test_class_distribution_stream_matches_batch(spark, scratch):
    ev, src = _events_as_files(spark, scratch)
    m, s = MO.reference_moments(ev)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 5).parquet(src)
    agg = MO.class_distribution(MO.prediction_log(stream, m, s))
    q = agg.writeStream.outputMode("complete").format("memory").queryName("cls_twin").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window_start"], r["predicted_class"]): r["n"] for r in spark.table("cls_twin").collect()}
    want = {(r["window_start"], r["predicted_class"]): r["n"]
            for r in MO.class_distribution(MO.prediction_log(ev, m, s)).collect()}
    assert got == want


def test_scoring_stream_quarantines_bad_rows(spark, scratch):
    from sparktab.models import train as TR
    c = table(spark, SF, "customer").withColumn("acct_text", F.col("c_acctbal").cast("string"))
    c = c.withColumn("acct_text", F.when(F.col("c_custkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("acct_text")))
    res = TR.train_model(c, c, "linear_regression", "regression", ["c_nationkey"], "c_acctbal", "c_custkey")
    src = os.path.join(scratch, "cust")
    c.write.parquet(src)
    stream = spark.readStream.schema(c.schema).parquet(src)
    q = ST.start_scoring_stream(stream, res.model, os.path.join(scratch, "out"), os.path.join(scratch, "bad"),
                                os.path.join(scratch, "ckpt2"), numeric=["acct_text"])
    q.awaitTermination(300)
    bad = c.where(F.col("acct_text") == "n/a").count()
    assert spark.read.parquet(os.path.join(scratch, "bad")).count() == bad
    assert spark.read.parquet(os.path.join(scratch, "out")).count() == c.count() - bad
