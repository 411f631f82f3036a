"""Column-expression building blocks (JVM side, whole-stage codegen).

Spark 4 runs in ANSI mode: division by zero, bad casts and ``corr`` of a
constant column raise.  Everything here uses ``try_divide`` / ``try_cast``
so that undefined results become null instead of failing the job."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def real(c) -> Column:
    """The value as double, null where it is NaN."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)


def clip(c, lo=None, hi=None) -> Column:
    """Clip keeping nulls null and NaN NaN (NaN sorts above every bound)."""
    out = col(c)
    x = real(c)
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)).otherwise(out)
    return out


def clip_negative(c) -> Column:
    x = col(c)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def pearson(a, b) -> Column:
    """Aggregate: Pearson r over rows where both are non-null and not NaN; null
    (not an error) when either side is constant.  Uses pair-masked moments."""
    x, y = real(a), real(b)
    both = x.isNotNull() & y.isNotNull()
    xm = F.when(both, x)
    ym = F.when(both, y)
    return F.try_divide(F.covar_pop(xm, ym),
                        F.stddev_pop(xm) * F.stddev_pop(ym))


def hist_bin(c, lo, hi, bins: int) -> Column:
    """Bin index 0..bins-1 with edges ``lo + i*((hi-lo)/bins)``; values on an
    interior edge go right, the maximum goes in the last bin (numpy's
    histogram with explicit edges).  ``lo``/``hi`` may be columns."""
    x = col(c)
    lo_c, hi_c = col(lo) if isinstance(lo, (str, Column)) else F.lit(lo), \
        col(hi) if isinstance(hi, (str, Column)) else F.lit(hi)
    step = (hi_c - lo_c) / F.lit(float(bins))
    b = F.lit(0)
    for i in range(1, bins):
        b = b + F.when(x >= F.lit(float(i)) * step + lo_c, 1).otherwise(0)
    return b


def rnd(c, digits: int = 6) -> Column:
    """Round half away from zero on the binary value: sign·⌊|x|·10^d + ½⌋/10^d
    in plain IEEE double arithmetic (``%`` is exact), so every engine that
    rounds the binary value gets the same digits.  ``round`` instead rounds
    the shortest decimal string and differs on ties such as 0.2408125."""
    x = col(c).cast("double")
    scale = float(10 ** digits)
    y = F.abs(x) * F.lit(scale) + F.lit(0.5)
    return F.signum(x) * (y - (y % F.lit(1.0))) / F.lit(scale)


def round_all(df, digits: int = 6, exclude: Sequence[str] = ()):
    """Round every double column (stable comparison across engines)."""
    out = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float") and name not in exclude:
            out.append(rnd(F.col(name), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(out)


def unpivot_numeric(df, columns: Sequence[str], ids: Sequence[str] = (),
                    var: str = "column", val: str = "value"):
    """Wide → long with every value cast to double (one scan, no shuffle)."""
    casted = df.select(*[F.col(i) for i in ids],
                       *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(ids), list(columns), var, val)


def unpivot_string(df, columns: Sequence[str], ids: Sequence[str] = (),
                   var: str = "column", val: str = "value"):
    casted = df.select(*[F.col(i) for i in ids],
                       *[F.col(c).cast("string").alias(c) for c in columns])
    return casted.unpivot(list(ids), list(columns), var, val)
