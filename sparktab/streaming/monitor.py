"""Operational aggregates over a prediction log.

Every function takes a batch or a streaming DataFrame: windows are event-time
``window()`` groupings, and with ``watermark`` set the same code runs under
Structured Streaming in append mode (late rows are dropped from windows but
kept in the log).  Histograms use cumulative ``le`` buckets and quantiles are
read from them by linear interpolation inside the bucket, like a metrics
backend's ``histogram_quantile``."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Histogram bucket bounds of the reference's request metrics.
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
CONFIDENCE_BUCKETS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0]
ANOMALY_SCORE_BUCKETS = [-3.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 3.0]
# Anomaly-rate baseline and alert multiple.
BASELINE_RATE = 0.05
ALERT_MULTIPLE = 2.0
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def prediction_log(events: DataFrame, score_mean: float, score_std: float) -> DataFrame:
    """Map the ``events`` table onto a prediction log: class =
    ``event_type``, latency seconds = value / 1000, confidence =
    0.5 + 0.5·exp(−value/100), anomaly score = z-score of value with the
    given reference moments, anomaly flag = score > 2."""
    v = F.col("value")
    score = (v - F.lit(score_mean)) / F.lit(score_std)
    return events.select(
        "event_id", "ts", F.col("event_type").alias("predicted_class"),
        (v / 1000.0).alias("latency_s"),
        (F.lit(0.5) + F.lit(0.5) * F.exp(-v / 100.0)).alias("confidence"),
        score.alias("anomaly_score"), (score > 2.0).cast("int").alias("is_anomaly"),
        F.pmod(F.col("user_id"), F.lit(8)).cast("int").alias("cluster_label"))


def reference_moments(events: DataFrame) -> tuple[float, float]:
    r = events.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    return float(r["m"]), float(r["s"])


def event_time(df: DataFrame, watermark: str | None) -> DataFrame:
    """Watermarks need TIMESTAMP event time: a TIMESTAMP_NTZ column is read
    in the session time zone (UTC in :func:`sparktab.session.get_spark`)."""
    if not watermark:
        return df
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def _win(log: DataFrame, duration: str, slide: str | None, watermark: str | None):
    log = event_time(log, watermark)
    w = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    return log, w


def _fmt(c):
    return F.date_format(c, TS_FORMAT)


def totals(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per label set."""
    return log.groupBy(*by).agg(F.count("*").cast("bigint").alias("total"))


def request_rate(log: DataFrame, duration: str = "5 minutes", slide: str = "1 minute",
                 seconds: int = 300, watermark: str | None = None) -> DataFrame:
    """R2: sliding-window request count and rate per second."""
    log, w = _win(log, duration, slide, watermark)
    g = log.groupBy(w.alias("w")).agg(F.count("*").cast("bigint").alias("n"))
    return g.select(_fmt("w.start").alias("window_start"), _fmt("w.end").alias("window_end"), "n",
                    (F.col("n") / float(seconds)).alias("rate_per_s"))


def cumulative_histogram(log: DataFrame, value: str, buckets: Sequence[float],
                         duration: str = "1 day", by: Sequence[str] = (),
                         watermark: str | None = None) -> DataFrame:
    """Per window, cumulative count of values <= each bound plus
    the +Inf bucket (= all rows).  One aggregation, stacked to long form."""
    log, w = _win(log, duration, None, watermark)
    aggs = [F.count_if(F.col(value) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs.append(F.count("*").alias(f"b{len(buckets)}"))
    g = log.groupBy(w.alias("w"), *by).agg(*aggs)
    les = list(buckets) + [float("inf")]
    stack = ", ".join(f"{i}, CAST('{le}' AS DOUBLE), b{i}" for i, le in enumerate(les))
    return g.selectExpr(f"date_format(w.start, '{TS_FORMAT}') AS window_start", *by,
                        f"stack({len(les)}, {stack}) AS (bucket, le, cum_count)")


def histogram_quantile(hist: DataFrame, q: float, by: Sequence[str] = ("window_start",)) -> DataFrame:
    """First bucket whose cumulative count reaches q·total, linear
    interpolation between its lower bound (previous bound, 0 for the first
    bucket) and its upper bound; the +Inf bucket answers the largest finite
    bound; an empty window answers null."""
    by = list(by)
    h = hist.alias("h")
    prev = hist.select(*by, (F.col("bucket") + 1).alias("bucket"),
                       F.col("le").alias("lo"), F.col("cum_count").alias("cum_prev"))
    j = h.join(prev, by + ["bucket"], "left").select(
        *by, "bucket", "le", "cum_count", F.coalesce("lo", F.lit(0.0)).alias("lo"),
        F.coalesce("cum_prev", F.lit(0)).alias("cum_prev"))
    tot = hist.groupBy(*by).agg(F.max("cum_count").alias("total"),
                                F.max(F.when(F.col("le") != F.lit(float("inf")), F.col("le"))).alias("max_le"))
    j = j.join(tot, by).withColumn("rank", F.lit(q) * F.col("total"))
    hit = j.where(F.col("cum_count") >= F.col("rank")).groupBy(*by).agg(
        F.min_by(F.struct("le", "lo", "cum_count", "cum_prev", "rank", "total", "max_le"),
                 F.col("bucket")).alias("b"))
    b = F.col("b")
    val = (F.when(b["total"] == 0, F.lit(None).cast("double"))
           .when(b["le"] == F.lit(float("inf")), b["max_le"])
           .otherwise(b["lo"] + (b["le"] - b["lo"]) * F.coalesce(
               F.try_divide(b["rank"] - b["cum_prev"], (b["cum_count"] - b["cum_prev"]).cast("double")),
               F.lit(0.0))))
    return hit.select(*by, val.alias(f"p{int(round(q * 100))}"))


def class_distribution(log: DataFrame, duration: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Predictions per class per window."""
    log, w = _win(log, duration, None, watermark)
    g = log.groupBy(w.alias("w"), "predicted_class").agg(F.count("*").cast("bigint").alias("n"))
    return g.select(_fmt("w.start").alias("window_start"), "predicted_class", "n")


def anomaly_rate(log: DataFrame, duration: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Share of anomalous predictions per tumbling window."""
    log, w = _win(log, duration, None, watermark)
    g = log.groupBy(w.alias("w")).agg(F.count("*").cast("bigint").alias("n"),
                                      F.avg("is_anomaly").alias("anomaly_rate"))
    return g.select(_fmt("w.start").alias("timestamp"), "n", "anomaly_rate")


def anomaly_rate_track(rates: DataFrame, baseline: float = BASELINE_RATE) -> DataFrame:
    """Parse, drop non-numeric rates, alert above 2 × baseline; count
    of alerting windows, mean and max rate."""
    r = rates.select(F.col("timestamp"), F.col("anomaly_rate").cast("string").try_cast("double").alias("rate"))
    r = r.where(F.col("rate").isNotNull())
    thr = ALERT_MULTIPLE * baseline
    return r.agg(F.count("*").cast("bigint").alias("windows"),
                 F.count_if(F.col("rate") > thr).cast("bigint").alias("windows_above"),
                 F.avg("rate").alias("mean_rate"), F.max("rate").alias("max_rate"),
                 (F.count_if(F.col("rate") > thr) > 0).alias("alert"))


def rate_spikes(rates: DataFrame) -> DataFrame:
    """Rate track in time order with the change from the previous
    window (lag over the time-ordered windows; one row per window)."""
    from pyspark.sql import Window
    w = Window.orderBy("timestamp")
    return rates.select("timestamp", "anomaly_rate",
                        (F.col("anomaly_rate") - F.lag("anomaly_rate").over(w)).alias("delta"))
