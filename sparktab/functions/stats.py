"""Distribution tail probabilities as JVM column expressions.

Both are written with higher-order ``aggregate`` over a short ``sequence`` so
they run inside whole-stage codegen on the (tiny) per-column result rows;
DuckDB twins used by the oracle live in :mod:`sparktab.plans.oracle`."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import col

# Chebyshev fit of erfc (Press et al., Numerical Recipes,
# "erfcc"), fractional error below 1.2e-7 for every argument.
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]

# Stephens' finite-sample correction of the Kolmogorov
# statistic, lambda = (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * D.
KS_A, KS_B = 0.12, 0.11
KS_TERMS = 100


def erfc_nonneg(z) -> Column:
    """erfc(z) for z >= 0."""
    z = col(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[1:-1]):
        poly = F.lit(c) + t * poly
    poly = F.lit(ERFC_COEFFS[0]) + t * poly
    return t * F.exp(-z * z + poly)


def chi2_sf(x, dof) -> Column:
    """Upper tail P(X >= x) of a chi-squared variable with integer ``dof``.

    Closed forms: even dof 2m → exp(-h)·Σ_{i<m} h^i/i!; odd dof 2m+1 →
    erfc(√h) + exp(-h)·Σ_{i=1..m} h^(i-1/2)/Γ(i+1/2), h = x/2, summed in log
    space so large statistics neither overflow nor underflow."""
    x, k = col(x).cast("double"), col(dof).cast("int")
    h = x / 2.0
    lh = F.log(h)
    m_even = F.floor(k / 2).cast("int")
    m_odd = F.floor((k - 1) / 2).cast("int")
    empty = F.array().cast("array<int>")
    even_terms = F.aggregate(
        F.when(m_even >= 1, F.sequence(F.lit(0), m_even - 1)).otherwise(empty),
        F.struct(F.lit(0.0).alias("lf"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct(
            (acc["lf"] + F.log(F.greatest(i, F.lit(1)).cast("double"))).alias("lf"),
            (acc["s"] + F.exp(-h + i * lh - (acc["lf"] + F.log(F.greatest(i, F.lit(1)).cast("double"))))).alias("s")),
        lambda acc: acc["s"])
    half_log_pi = 0.5 * math.log(math.pi)
    odd_terms = F.aggregate(
        F.when(m_odd >= 1, F.sequence(F.lit(1), m_odd)).otherwise(empty),
        F.struct(F.lit(half_log_pi).alias("lg"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct(
            (acc["lg"] + F.log(i - 0.5)).alias("lg"),
            (acc["s"] + F.exp(-h + (i - 0.5) * lh - (acc["lg"] + F.log(i - 0.5)))).alias("s")),
        lambda acc: acc["s"])
    odd = erfc_nonneg(F.sqrt(h)) + odd_terms
    p = F.when(k % 2 == 0, even_terms).otherwise(odd)
    return (F.when(x.isNull() | k.isNull() | (k < 1), F.lit(None).cast("double"))
            .when(x <= 0, F.lit(1.0))
            .otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))


def ks_pvalue(d, n1, n2) -> Column:
    """Two-sided two-sample KS p-value by the Kolmogorov series with
    Stephens' correction at the effective size n1·n2/(n1+n2)."""
    d, n1, n2 = col(d).cast("double"), col(n1).cast("double"), col(n2).cast("double")
    en = n1 * n2 / (n1 + n2)
    lam = (F.sqrt(en) + KS_A + KS_B / F.sqrt(en)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.lit(2.0) * F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return (F.when(d.isNull(), F.lit(None).cast("double"))
            .when(lam < 0.2, F.lit(1.0))
            .otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))))
