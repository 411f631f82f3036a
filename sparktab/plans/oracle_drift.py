"""DuckDB twins of the drift queries (generated SQL text)."""
from __future__ import annotations

import math

from ..functions.stats import ERFC_COEFFS, KS_A, KS_B, KS_TERMS
from ..operators.drift import ALPHA, EPS, MIN_VALUES, PSI_BINS, PSI_NONE, PSI_SLIGHT, CHI2_RTOL

LABEL_SQL = (f"CASE WHEN {{p}} IS NULL THEN NULL WHEN {{p}} < {PSI_NONE} THEN 'No drift' "
             f"WHEN {{p}} < {PSI_SLIGHT} THEN 'Slight drift' ELSE 'Significant drift' END")
COLOR_SQL = (f"CASE WHEN {{p}} IS NULL THEN NULL WHEN {{p}} < {PSI_NONE} THEN 'green' "
             f"WHEN {{p}} < {PSI_SLIGHT} THEN 'orange' ELSE 'red' END")


def ks_p_sql(d: str, n1: str, n2: str) -> str:
    en = f"(CAST({n1} AS DOUBLE)*{n2}/({n1}+{n2}))"
    lam = f"((sqrt({en}) + {KS_A} + {KS_B}/sqrt({en})) * {d})"
    series = (f"(SELECT sum(2.0 * (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * "
              f"exp(-2.0 * k * k * {lam} * {lam})) FROM range(1, {KS_TERMS + 1}) t(k))")
    return (f"(CASE WHEN {d} IS NULL THEN NULL WHEN {lam} < 0.2 THEN 1.0 "
            f"ELSE least(greatest({series}, 0.0), 1.0) END)")


def erfc_sql(z: str) -> str:
    t = f"(1.0/(1.0+0.5*{z}))"
    poly = f"{ERFC_COEFFS[-1]}"
    for c in reversed(ERFC_COEFFS[1:-1]):
        poly = f"({c} + {t}*{poly})"
    poly = f"({ERFC_COEFFS[0]} + {t}*{poly})"
    return f"({t}*exp(-{z}*{z} + {poly}))"


def chi2_sf_sql(x: str, k: str) -> str:
    h = f"({x}/2.0)"
    even = (f"(SELECT coalesce(sum(exp(-{h} + i*ln({h}) - lgamma(i+1))), 0) "
            f"FROM range(0, CAST(floor({k}/2) AS BIGINT)) t(i))")
    odd = (f"({erfc_sql(f'sqrt({h})')} + (SELECT coalesce(sum(exp(-{h} + (i-0.5)*ln({h}) "
           f"- lgamma(i+0.5))), 0) FROM range(1, CAST(floor(({k}-1)/2) AS BIGINT)+1) t(i)))")
    p = f"(CASE WHEN {k} % 2 = 0 THEN {even} ELSE {odd} END)"
    return (f"(CASE WHEN {x} IS NULL OR {k} IS NULL OR {k} < 1 THEN NULL "
            f"WHEN {x} <= 0 THEN 1.0 ELSE least(greatest({p}, 0.0), 1.0) END)")


def _long(table: str, cols, side_expr: str, cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS value, {side_expr} AS side FROM {table}"
        for c in cols)


def numeric_drift_sql(table: str, cols, ref_pred: str, bins: int = PSI_BINS) -> str:
    side = f"CASE WHEN {ref_pred} THEN 0 ELSE 1 END"
    names = " UNION ALL ".join(f"SELECT '{c}' AS \"column\"" for c in cols)
    bin_expr = " + ".join(
        f"(CASE WHEN value >= {float(i)} * ((hi - lo) / {float(bins)}) + lo THEN 1 ELSE 0 END)"
        for i in range(1, bins)) or "0"
    p = ks_p_sql("d", "n_ref", "n_cur")
    return f"""
WITH long AS ({_long(table, cols, side, 'DOUBLE')}),
counts AS (SELECT "column", value, count(*) FILTER (WHERE side = 0) AS a,
           count(*) FILTER (WHERE side = 1) AS b
           FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY "column", value),
st AS (SELECT "column", sum(a) AS n_ref, sum(b) AS n_cur, min(value) AS lo, max(value) AS hi
       FROM counts GROUP BY "column"),
cum AS (SELECT "column", value, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM counts
        WINDOW w AS (PARTITION BY "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT cum."column", max(abs(ca / n_ref - cb / n_cur)) AS d FROM cum JOIN st USING ("column")
       GROUP BY cum."column"),
binned AS (SELECT c."column", ({bin_expr}) AS bin, a, b FROM counts c JOIN st USING ("column")),
bsum AS (SELECT "column", bin, sum(a) AS a, sum(b) AS b FROM binned GROUP BY "column", bin),
grid AS (SELECT "column", n_ref, n_cur, lo, hi, g.bin FROM st, range(0, {bins}) g(bin)),
full_ AS (SELECT grid.*, coalesce(bsum.a, 0) AS a, coalesce(bsum.b, 0) AS b FROM grid
          LEFT JOIN bsum ON grid."column" = bsum."column" AND grid.bin = bsum.bin),
psi AS (SELECT "column", CASE WHEN min(lo) = max(hi) THEN 0.0 ELSE
        sum(((b + {EPS}) / (n_cur + {EPS} * {bins}) - (a + {EPS}) / (n_ref + {EPS} * {bins}))
            * ln(((b + {EPS}) / (n_cur + {EPS} * {bins})) / ((a + {EPS}) / (n_ref + {EPS} * {bins})))) END AS psi_raw
        FROM full_ GROUP BY "column"),
base AS (SELECT n."column", coalesce(st.n_ref, 0) AS n_ref, coalesce(st.n_cur, 0) AS n_cur, ks.d, psi.psi_raw
         FROM ({names}) n LEFT JOIN st USING ("column") LEFT JOIN ks USING ("column") LEFT JOIN psi USING ("column")),
res AS (SELECT *, (n_ref < {MIN_VALUES} OR n_cur < {MIN_VALUES}) AS few, {p} AS p_raw FROM base)
SELECT "column", 'numerical' AS kind, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
  CASE WHEN few THEN NULL ELSE round(d, 4) END AS ks_statistic,
  CASE WHEN few THEN NULL ELSE round(p_raw, 4) END AS ks_pvalue,
  CASE WHEN few THEN NULL ELSE round(psi_raw, 4) END AS psi,
  CASE WHEN few THEN NULL ELSE {LABEL_SQL.format(p='psi_raw')} END AS drift_label,
  CASE WHEN few THEN NULL ELSE {COLOR_SQL.format(p='psi_raw')} END AS drift_color,
  CASE WHEN few THEN NULL ELSE (psi_raw >= {PSI_NONE} OR p_raw < {ALPHA}) END AS drifted,
  CASE WHEN few THEN 'Insufficient non-null values (<5).' END AS error
FROM res"""


def categorical_drift_sql(table: str, cols, ref_pred: str) -> str:
    side = f"CASE WHEN {ref_pred} THEN 0 ELSE 1 END"
    names = " UNION ALL ".join(f"SELECT '{c}' AS \"column\"" for c in cols)
    p = chi2_sf_sql("stat", "(k - 1)")
    return f"""
WITH long AS ({_long(table, cols, side, 'VARCHAR')}),
counts AS (SELECT "column", value,
           count(*) FILTER (WHERE side = 0 AND value IS NOT NULL) AS a,
           count(*) FILTER (WHERE side = 1 AND value IS NOT NULL) AS b
           FROM long GROUP BY "column", value),
rep AS (SELECT "column", CASE WHEN a > 0 THEN CAST(a AS DOUBLE) ELSE {EPS} END AS ra,
        CASE WHEN b > 0 THEN CAST(b AS DOUBLE) ELSE {EPS} END AS rb FROM counts),
rt AS (SELECT "column", sum(ra) AS tot_ra, sum(rb) AS tot_rb FROM rep GROUP BY "column"),
psi AS (SELECT "column", sum((rb / tot_rb - ra / tot_ra) * ln((rb / tot_rb) / (ra / tot_ra))) AS psi_raw
        FROM rep JOIN rt USING ("column") GROUP BY "column"),
tot AS (SELECT "column", sum(a) AS NA, sum(b) AS NB FROM counts GROUP BY "column"),
ch AS (SELECT "column", min(NA) AS NA, min(NB) AS NB, count(*) FILTER (WHERE a > 0) AS k,
       sum(CASE WHEN a > 0 THEN CAST(b AS DOUBLE) END) AS obs,
       sum(CASE WHEN a > 0 THEN CAST(a AS DOUBLE) / NA * NB END) AS exp_,
       sum(CASE WHEN a > 0 THEN (b - CAST(a AS DOUBLE) / NA * NB) * (b - CAST(a AS DOUBLE) / NA * NB)
           / (CAST(a AS DOUBLE) / NA * NB) END) AS stat
       FROM counts JOIN tot USING ("column") GROUP BY "column"),
chi AS (SELECT "column", NA, NB, CASE WHEN NA > 0 AND NB > 0 AND k >= 2
        AND abs(obs - exp_) <= {CHI2_RTOL} * greatest(obs, exp_) THEN stat END AS stat, k FROM ch),
res AS (SELECT n."column", coalesce(chi.NA, 0) AS n_ref, coalesce(chi.NB, 0) AS n_cur,
        chi.stat AS chi2_raw, {p} AS p_raw, coalesce(psi.psi_raw, 0.0) AS psi_raw
        FROM ({names}) n LEFT JOIN chi USING ("column") LEFT JOIN psi USING ("column"))
SELECT "column", 'categorical' AS kind, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
  round(chi2_raw, 4) AS chi2_statistic, round(p_raw, 4) AS chi2_pvalue, round(psi_raw, 4) AS psi,
  {LABEL_SQL.format(p='psi_raw')} AS drift_label, {COLOR_SQL.format(p='psi_raw')} AS drift_color,
  (psi_raw >= {PSI_NONE} OR coalesce(p_raw < {ALPHA}, false)) AS drifted,
  CAST(NULL AS VARCHAR) AS error
FROM res"""


REPORT = ["\"column\"", "kind", "n_ref", "n_cur", "ks_statistic", "ks_pvalue", "chi2_statistic",
          "chi2_pvalue", "psi", "drift_label", "drift_color", "drifted", "error"]


def drift_report_sql(table: str, num_cols, cat_cols, ref_pred: str) -> str:
    n = numeric_drift_sql(table, num_cols, ref_pred)
    c = categorical_drift_sql(table, cat_cols, ref_pred)
    nsel = ", ".join(x if x not in ("chi2_statistic", "chi2_pvalue")
                     else f"CAST(NULL AS DOUBLE) AS {x}" for x in REPORT)
    csel = ", ".join(x if x not in ("ks_statistic", "ks_pvalue")
                     else f"CAST(NULL AS DOUBLE) AS {x}" for x in REPORT)
    return f"SELECT {nsel} FROM ({n}) UNION ALL SELECT {csel} FROM ({c})"


def drift_summary_sql(report_sql: str) -> str:
    return f"""
SELECT CAST(count(*) AS BIGINT) AS total_columns,
  CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS tested_columns,
  CAST(count(*) FILTER (WHERE error IS NULL AND drifted) AS BIGINT) AS drifted_columns,
  coalesce(round(CAST(count(*) FILTER (WHERE error IS NULL AND drifted) AS DOUBLE)
     / nullif(count(*) FILTER (WHERE error IS NULL), 0), 3), 0.0) AS drift_rate,
  coalesce(max(psi) FILTER (WHERE error IS NULL), 0.0) AS max_psi,
  coalesce(array_to_string(list_sort(list("column") FILTER (WHERE error IS NULL AND drifted)), ','), '')
     AS drifted_column_names
FROM ({report_sql})"""
