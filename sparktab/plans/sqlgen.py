"""Small generators for the DuckDB oracle text (long forms, fixtures)."""
from __future__ import annotations

from ..functions.keys import hash_key_sql
from ..operators.kinds import DATETIME_PATTERNS

ORDERS_N = """orders_n AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_n,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority_n,
  CAST(1 AS DOUBLE) AS const_one,
  CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS bad_num
  FROM orders)"""

# column → static kind (None = string, decided from data)
ORDERS_N_COLS = [("o_orderkey", "numerical"), ("o_custkey", "numerical"),
                 ("o_orderstatus", None), ("o_totalprice", "numerical"),
                 ("o_orderdate", "datetime"), ("o_orderpriority", None),
                 ("price_n", "numerical"), ("priority_n", None),
                 ("const_one", "numerical"), ("bad_num", None)]
ORDERS_N_NUM = [c for c, k in ORDERS_N_COLS if k == "numerical"]


def q(name: str) -> str:
    return f'"{name}"'


def long_numeric(table: str, cols, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value{extra} FROM {table}" for c in cols)


def long_string(table: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {table}" for c in cols)


def parse_ts(x: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{d}')" for _, d in DATETIME_PATTERNS) + ")"


def missing_flag(c: str, floating: bool) -> str:
    return f"({c} IS NULL OR isnan({c}))" if floating else f"({c} IS NULL)"


def kinds_sql(table: str, cols) -> str:
    parts = []
    for c, k in cols:
        if k is None:
            parts.append(f"""SELECT '{c}' AS "column",
  (SELECT count(DISTINCT {c}) FROM {table}) AS nu,
  (SELECT count(*) FROM (SELECT DISTINCT {c} AS v FROM {table} WHERE {c} IS NOT NULL)
     WHERE {parse_ts('v')} IS NULL) AS nb, NULL AS sk""")
        else:
            parts.append(f"SELECT '{c}' AS \"column\", NULL AS nu, NULL AS nb, '{k}' AS sk")
    body = " UNION ALL ".join(parts)
    return f"""SELECT "column", CASE WHEN sk IS NOT NULL THEN sk WHEN nb = 0 THEN 'datetime'
  WHEN nu <= 20 OR (n_rows > 0 AND CAST(nu AS DOUBLE) / n_rows < 0.05) THEN 'categorical'
  ELSE 'text' END AS kind, CAST(CASE WHEN sk IS NULL THEN nu END AS BIGINT) AS n_unique,
  CAST(n_rows AS BIGINT) AS n_rows
FROM ({body}) k, (SELECT count(*) AS n_rows FROM {table}) r"""


def hash_order(key: str, seed: int = 42) -> str:
    return hash_key_sql(key, seed)
