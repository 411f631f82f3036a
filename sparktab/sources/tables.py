"""Table scans for the test star schema and for user files."""
from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; filters and projections applied
    later are pushed into this scan by Catalyst.  How many tasks read it is
    up to ``spark.sql.files.maxPartitionBytes`` and the files' row groups."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _is_document(spark: SparkSession, path: str) -> bool:
    """True for one JSON value over several lines or an array, False for JSON lines."""
    line = spark.read.text(path).where("length(trim(value)) > 0").first()
    if line is None:
        return False
    try:
        return not isinstance(json.loads(line["value"]), dict)
    except ValueError:
        return True


def load_dataset(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Format dispatch by extension (S1 CSV; S2 JSON lines or
    documents; Parquet).  Any other
    extension raises ``ValueError`` naming the extension (S3).  An explicit
    schema skips the inference pass."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if ext == ".csv":
        opts = {"header": "true", "inferSchema": "false" if schema is not None else "true"}
        opts.update(options)
        return reader.options(**opts).csv(path)
    if ext in (".json", ".jsonl"):
        return reader.options(**({"multiLine": _is_document(spark, path)} | options)).json(path)
    if ext in (".parquet", ""):
        return reader.options(**options).parquet(path)
    raise ValueError(f"Unsupported file format: '{ext}'. Use CSV, JSON or Parquet.")
