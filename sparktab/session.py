"""Session helpers: a tuned local/cluster session and the checkpoint folder."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "sparktab", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes:
    UTC session time zone, AQE with partition coalescing and skew-join
    splitting, Arrow for the few pandas UDFs, and no UI server."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is respected as
    is; only when it is unset and the master is ``local`` (tests) a private
    temporary folder is created.  Lineage of iterative jobs is cut with ``checkpoint()`` into
    this folder, never with ``localCheckpoint``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sparktab-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers.

    Spark serves the zip to every executor; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_sparktab_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    _SHIPPED.append(folder := tempfile.TemporaryDirectory(prefix="sparktab-ship-"))
    path = os.path.join(folder.name, "sparktab.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(at, name)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._sparktab_shipped = True


#: Folders of the driver that Spark serves files from; they go with the process.
_SHIPPED: list[tempfile.TemporaryDirectory] = []


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: lineage is cut, and a lost executor rereads shared files."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)
