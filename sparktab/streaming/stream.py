"""Structured Streaming jobs.

R10 — windowed drift: bin edges are frozen from the reference table (outer
bins open, so a value outside the reference range still lands in the first
or last bin), the stream counts (window, bin) with a watermark in append
mode, and every finalised window's PSI against the reference shares is
computed inside ``foreachBatch`` and written to a table.  The same
:func:`windowed_psi` runs on a batch frame, which is the batch twin.

R11 — streaming scoring: the fitted ``PipelineModel`` transforms each
micro-batch; rows failing validation go to a quarantine sink.  Both jobs use
a checkpoint location, and each micro-batch overwrites its own ``epoch=N`` folder
of the sink, so a batch that is replayed after a failure is there once."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hist_bin
from ..operators.drift import EPS, PSI_BINS, psi_label

WATERMARK = "10 minutes"


def reference_bins(ref: DataFrame, value: str, bins: int = PSI_BINS):
    """Frozen edges (lo, hi) and the reference bin shares (bin, ref_share)."""
    st = ref.agg(F.min(F.col(value).cast("double")).alias("lo"), F.max(F.col(value).cast("double")).alias("hi"),
                 F.count(value).alias("n")).first()
    lo, hi, n = st["lo"], st["hi"], st["n"]
    counts = (ref.where(F.col(value).isNotNull())
              .select(hist_bin(F.col(value).cast("double"), lo, hi, bins).alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("c")))
    grid = ref.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    shares = grid.join(counts, "bin", "left").select(
        "bin", ((F.coalesce("c", F.lit(0)) + EPS) / (F.lit(n) + EPS * bins)).alias("ref_share"))
    return lo, hi, shares


def window_bin_counts(df: DataFrame, value: str, lo: float, hi: float, bins: int = PSI_BINS,
                      duration: str = "1 day", watermark: str | None = None) -> DataFrame:
    from .monitor import event_time
    df = event_time(df, watermark)
    b = hist_bin(F.col(value).cast("double"), lo, hi, bins)
    return (df.where(F.col(value).isNotNull()).select(F.window("ts", duration).alias("w"), b.alias("bin"))
            .groupBy("w", "bin").agg(F.count("*").alias("c")))


def psi_per_window(counts: DataFrame, shares: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """PSI of every window's bin counts against the frozen reference shares
    (additive eps smoothing; empty bins included via the shares grid)."""
    wins = counts.select("w").distinct()
    grid = wins.crossJoin(F.broadcast(shares))  # windows × bins (bins is fixed)
    j = grid.join(counts, ["w", "bin"], "left").fillna(0, ["c"])
    tot = counts.groupBy("w").agg(F.sum("c").alias("n"))
    j = j.join(tot, "w")
    cur = (F.col("c") + EPS) / (F.col("n") + EPS * bins)
    r = F.col("ref_share")
    out = j.groupBy("w").agg(F.sum((cur - r) * F.log(cur / r)).alias("psi"), F.first("n").alias("n"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      F.col("n").cast("bigint").alias("n"), "psi", psi_label("psi").alias("drift_label"))


def windowed_psi(ref: DataFrame, cur: DataFrame, value: str, duration: str = "1 day",
                 bins: int = PSI_BINS) -> DataFrame:
    """R10 batch twin."""
    lo, hi, shares = reference_bins(ref, value, bins)
    return psi_per_window(window_bin_counts(cur, value, lo, hi, bins, duration), shares, bins)


def start_windowed_psi_stream(ref: DataFrame, stream: DataFrame, value: str, sink_path: str,
                              checkpoint: str, duration: str = "1 day", bins: int = PSI_BINS,
                              watermark: str = WATERMARK, available_now: bool = True):
    """R10 streaming job: finalised windows only (append mode)."""
    lo, hi, shares = reference_bins(ref, value, bins)
    shares = shares.cache()
    counts = window_bin_counts(stream, value, lo, hi, bins, duration, watermark)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        psi_per_window(batch, shares, bins).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")

    w = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(per_batch)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def start_scoring_stream(stream: DataFrame, model, sink_path: str, quarantine_path: str, checkpoint: str,
                         numeric: Sequence[str] = (), required: Sequence[str] = (), task: str = "regression",
                         classes: Sequence[str] | None = None, available_now: bool = True):
    """Validate (P11) → score good rows → append; bad rows with their
    error list → quarantine.  One checkpoint covers both sinks."""
    from ..models.train import score
    from ..operators.clean import validate_rows

    def per_batch(batch: DataFrame, epoch: int) -> None:
        v = validate_rows(batch, list(numeric), list(required)).persist()
        good = v.where(F.size("errors") == 0).drop("errors")
        bad = v.where(F.size("errors") > 0)
        scored = score(model, good, task, classes)
        keep = [c for c in scored.columns if c not in ("features", "rawPrediction", "probability")]
        scored.select(*keep).write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/epoch={epoch}")
        v.unpersist()

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(per_batch)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
