"""Monitoring queries over ``events`` read as a prediction log."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import round_all
from ..sources.tables import table
from ..streaming import monitor as MO
from .registry import query

LOG = """mom AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events),
log AS (SELECT event_id, ts, event_type AS predicted_class, value / 1000.0 AS latency_s,
  0.5 + 0.5 * exp(-value / 100.0) AS confidence, (value - m) / s AS anomaly_score,
  CAST((value - m) / s > 2.0 AS INT) AS is_anomaly, CAST(user_id % 8 AS INT) AS cluster_label FROM events, mom)"""
DAY = "strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S')"


def log_of(spark, sf):
    ev = table(spark, sf, "events")
    m, s = MO.reference_moments(ev)
    return MO.prediction_log(ev, m, s)


def _hist_sql(value: str, buckets) -> str:
    vals = ", ".join(f"({i}, CAST({b} AS DOUBLE))" for i, b in enumerate(buckets))
    vals += f", ({len(buckets)}, CAST('inf' AS DOUBLE))"
    return f"""SELECT {DAY} AS window_start, b.i AS bucket, b.le, count(*) FILTER (WHERE {value} <= b.le) AS cum_count
  FROM log, (VALUES {vals}) b(i, le) GROUP BY 1, 2, 3"""


def _quantile_sql(hist_cte: str, q: float, name: str) -> str:
    return f"""j_{name} AS (SELECT h.*, coalesce(p.le, 0.0) AS lo, coalesce(p.cum_count, 0) AS cum_prev FROM {hist_cte} h
  LEFT JOIN {hist_cte} p ON p.window_start = h.window_start AND p.bucket + 1 = h.bucket),
t_{name} AS (SELECT window_start, max(cum_count) AS total, max(le) FILTER (WHERE le <> CAST('inf' AS DOUBLE)) AS max_le FROM {hist_cte} GROUP BY 1),
hit_{name} AS (SELECT j.*, t.total, t.max_le, CAST({q} AS DOUBLE) * t.total AS rk, row_number() OVER (PARTITION BY j.window_start ORDER BY bucket) AS rn
  FROM j_{name} j JOIN t_{name} t USING (window_start) WHERE cum_count >= CAST({q} AS DOUBLE) * t.total),
{name} AS (SELECT window_start, CASE WHEN total = 0 THEN NULL WHEN le = CAST('inf' AS DOUBLE) THEN max_le
  ELSE lo + (le - lo) * coalesce((rk - cum_prev) / nullif(CAST(cum_count - cum_prev AS DOUBLE), 0), 0.0) END AS {name}
  FROM hit_{name} WHERE rn = 1)"""


@query("monitor_totals", f"WITH {LOG} SELECT predicted_class, CAST(count(*) AS BIGINT) AS total FROM log GROUP BY 1")
def monitor_totals(spark, sf):
    return MO.totals(log_of(spark, sf), ["predicted_class"])


@query("monitor_cluster_counts", f"WITH {LOG} SELECT cluster_label, CAST(count(*) AS BIGINT) AS total FROM log GROUP BY 1")
def monitor_cluster_counts(spark, sf):
    return MO.totals(log_of(spark, sf), ["cluster_label"])


@query("monitor_request_rate", f"""WITH {LOG}, w AS (SELECT time_bucket(INTERVAL '1 minute', ts) - i * INTERVAL '1 minute' AS s
  FROM log, range(0, 5) t(i))
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL '5 minute', '%Y-%m-%d %H:%M:%S') AS window_end,
  CAST(count(*) AS BIGINT) AS n, round(count(*) / 300.0, 6) AS rate_per_s FROM w GROUP BY s""")
def monitor_request_rate(spark, sf):
    return round_all(MO.request_rate(log_of(spark, sf)), 6)


@query("monitor_latency_histogram", f"WITH {LOG} {_hist_sql('latency_s', MO.LATENCY_BUCKETS)}")
def monitor_latency_histogram(spark, sf):
    return MO.cumulative_histogram(log_of(spark, sf), "latency_s", MO.LATENCY_BUCKETS)


@query("monitor_latency_quantiles", f"""WITH {LOG}, h AS ({_hist_sql('latency_s', MO.LATENCY_BUCKETS)}),
{_quantile_sql('h', 0.5, 'p50')}, {_quantile_sql('h', 0.95, 'p95')}, {_quantile_sql('h', 0.99, 'p99')}
SELECT window_start, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM p50 JOIN p95 USING (window_start) JOIN p99 USING (window_start)""")
def monitor_latency_quantiles(spark, sf):
    h = MO.cumulative_histogram(log_of(spark, sf), "latency_s", MO.LATENCY_BUCKETS)
    out = (MO.histogram_quantile(h, 0.5).join(MO.histogram_quantile(h, 0.95), "window_start")
           .join(MO.histogram_quantile(h, 0.99), "window_start"))
    return round_all(out, 6)


@query("monitor_class_distribution", f"WITH {LOG} SELECT {DAY} AS window_start, predicted_class, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1, 2")
def monitor_class_distribution(spark, sf):
    return MO.class_distribution(log_of(spark, sf))


@query("monitor_confidence_median", f"""WITH {LOG}, h AS ({_hist_sql('confidence', MO.CONFIDENCE_BUCKETS)}), {_quantile_sql('h', 0.5, 'p50')}
SELECT window_start, round(p50, 6) AS p50 FROM p50""")
def monitor_confidence_median(spark, sf):
    h = MO.cumulative_histogram(log_of(spark, sf), "confidence", MO.CONFIDENCE_BUCKETS)
    return round_all(MO.histogram_quantile(h, 0.5), 6)


@query("monitor_anomaly_score_histogram", f"WITH {LOG} {_hist_sql('anomaly_score', MO.ANOMALY_SCORE_BUCKETS)}")
def monitor_anomaly_score_histogram(spark, sf):
    return MO.cumulative_histogram(log_of(spark, sf), "anomaly_score", MO.ANOMALY_SCORE_BUCKETS)


RATE_SQL = f"SELECT {DAY} AS \"timestamp\", CAST(count(*) AS BIGINT) AS n, avg(is_anomaly) AS anomaly_rate FROM log GROUP BY 1"


@query("monitor_anomaly_rate", f"WITH {LOG} SELECT \"timestamp\", n, round(anomaly_rate, 6) AS anomaly_rate FROM ({RATE_SQL})")
def monitor_anomaly_rate(spark, sf):
    return round_all(MO.anomaly_rate(log_of(spark, sf)), 6)


@query("anomaly_rate_track", f"""WITH {LOG}, r AS ({RATE_SQL}), v AS (SELECT TRY_CAST(CAST(anomaly_rate AS VARCHAR) AS DOUBLE) AS rate FROM r)
SELECT CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE rate > 0.1) AS BIGINT) AS windows_above,
  round(avg(rate), 6) AS mean_rate, round(max(rate), 6) AS max_rate, count(*) FILTER (WHERE rate > 0.1) > 0 AS alert
FROM v WHERE rate IS NOT NULL""")
def anomaly_rate_track(spark, sf):
    return round_all(MO.anomaly_rate_track(MO.anomaly_rate(log_of(spark, sf))), 6)


# ------------------------------------------------------------ R10 batch twin
from ..streaming import stream as ST  # noqa: E402

REF_CUT = "2024-01-08"


@query("windowed_psi", f"""WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '{REF_CUT}'),
st AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n FROM ref),
rb AS (SELECT {' + '.join(f"(CASE WHEN value >= {float(i)} * ((hi - lo) / 10.0) + lo THEN 1 ELSE 0 END)" for i in range(1, 10))} AS bin FROM ref, st),
shares AS (SELECT g.bin, (coalesce(c, 0) + 1e-8) / (n + 1e-8 * 10) AS ref_share FROM range(0, 10) g(bin)
  LEFT JOIN (SELECT bin, count(*) AS c FROM rb GROUP BY bin) x ON x.bin = g.bin, st),
cur AS (SELECT time_bucket(INTERVAL '1 day', ts) AS w, {' + '.join(f"(CASE WHEN value >= {float(i)} * ((hi - lo) / 10.0) + lo THEN 1 ELSE 0 END)" for i in range(1, 10))} AS bin
  FROM events, st WHERE ts >= TIMESTAMP '{REF_CUT}' AND value IS NOT NULL),
cnt AS (SELECT w, bin, count(*) AS c FROM cur GROUP BY w, bin),
tot AS (SELECT w, sum(c) AS n FROM cnt GROUP BY w),
j AS (SELECT t.w, s.bin, s.ref_share, coalesce(cnt.c, 0) AS c, t.n FROM tot t CROSS JOIN shares s LEFT JOIN cnt ON cnt.w = t.w AND cnt.bin = s.bin),
p AS (SELECT w, min(n) AS n, sum(((c + 1e-8) / (n + 1e-8 * 10) - ref_share) * ln(((c + 1e-8) / (n + 1e-8 * 10)) / ref_share)) AS psi FROM j GROUP BY w)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(n AS BIGINT) AS n, round(psi, 6) AS psi,
  CASE WHEN psi < 0.1 THEN 'No drift' WHEN psi < 0.25 THEN 'Slight drift' ELSE 'Significant drift' END AS drift_label FROM p""")
def windowed_psi(spark, sf):
    ev = table(spark, sf, "events")
    cut = F.lit(REF_CUT).cast("timestamp_ntz")
    return round_all(ST.windowed_psi(ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut), "value"), 6)


@query("anomaly_rate_spikes", f"""WITH {LOG}, r AS ({RATE_SQL})
SELECT "timestamp", round(anomaly_rate, 6) AS anomaly_rate, round(anomaly_rate - lag(anomaly_rate) OVER (ORDER BY "timestamp"), 6) AS delta FROM r""")
def anomaly_rate_spikes(spark, sf):
    """Daily anomaly rate in time order with the change from the day before."""
    return round_all(MO.rate_spikes(MO.anomaly_rate(log_of(spark, sf))), 6)
