"""Registry of named queries: Spark callables and their DuckDB twins.

Each module under ``sparktab.plans`` registers ``(spark, sf_dir) -> DataFrame``
callables with :func:`query` and, when the answer is SQL-expressible, the
equivalent DuckDB text with :func:`oracle`."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import (  # noqa: F401
        q_attribution, q_boosting, q_closed, q_drift, q_hierarchy, q_metrics, q_misc, q_models, q_monitor, q_neighbors, q_ops, q_prep, q_profile)
