"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktab.session import written  # noqa: F401

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_frame(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, text[, more]) under fixed names; a null text is the empty text."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def join_spans(spans: Iterable[tuple[str, int, int]], order: dict[str, int]) -> str:
    """``kind:start:end`` by start, then kind as listed in ``order``, then end."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in
                    sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
