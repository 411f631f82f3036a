"""Processed-split storage, prediction output and model registry tables
(S4, S5, S8, S9, X3, X4).  Everything is written through Spark writers, so
the paths may be on any shared filesystem the cluster mounts."""
from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def save_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One partition folder per split (``split=train`` …), header row for
    CSV.  A split without rows still gets a (header-only) folder."""
    w = df.write.mode("overwrite").partitionBy("split")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path))
    spark = df.sparkSession
    for s in SPLITS:
        sub = f"{path}/split={s}"
        if not _exists(spark, sub):
            empty = df.limit(0).drop("split")
            (empty.write.mode("overwrite").option("header", "true").csv(sub) if fmt == "csv"
             else empty.write.mode("overwrite").parquet(sub))


def load_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """Partition-pruned read of one split; a missing split folder raises
    naming the split."""
    if not _exists(spark, f"{path}/split={split}"):
        raise FileNotFoundError(f"processed split '{split}' not found under {path}")
    r = spark.read.option("header", "true").csv(path) if fmt == "csv" else spark.read.parquet(path)
    return r.where(F.col("split") == split)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Scored rows as CSV (header) or Parquet; array columns joined."""
    out = df.select(*[F.concat_ws(";", F.col(c).cast("array<string>")).alias(c) if t.startswith("array")
                      else F.col(c) for c, t in df.dtypes if not t.startswith("vector") and t != "struct"])
    w = out.write.mode("overwrite")
    (w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path))


REGISTRY_SCHEMA = "name string, version int, run_id string, model_path string, metric double, saved_at timestamp"
HISTORY_SCHEMA = ("ts timestamp, model_name string, task string, metric_name string, old_metric double, "
                  "new_metric double, improved boolean, promoted_version int, run_id string")


def register_model(spark: SparkSession, registry_path: str, name: str, run_id: str, model_path: str,
                   metric: float | None) -> int:
    """Append (name, version = max + 1, run id, path)."""
    version = 1
    if _exists(spark, registry_path):
        v = spark.read.parquet(registry_path).where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = (v or 0) + 1
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(name, version, run_id, model_path, metric, now)], REGISTRY_SCHEMA) \
        .write.mode("append").parquet(registry_path)
    return version


def active_model(spark: SparkSession, registry_path: str, name: str) -> DataFrame:
    """The newest registered version of ``name`` (one row)."""
    r = spark.read.parquet(registry_path).where(F.col("name") == name)
    return r.agg(F.max_by(F.struct("version", "model_path", "run_id", "saved_at"), "version").alias("a")) \
        .select("a.version", "a.model_path", "a.run_id", "a.saved_at")


def append_history(spark: SparkSession, path: str, row: Sequence) -> DataFrame:
    df = spark.createDataFrame([tuple(row)], HISTORY_SCHEMA)
    df.write.mode("append").parquet(path)
    return df


def history(spark: SparkSession, path: str) -> DataFrame:
    """Retraining history, newest first."""
    return spark.read.parquet(path).orderBy(F.desc("ts"))
