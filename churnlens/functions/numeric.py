"""Exact rounding and guarded statistics as Column expressions.

Counts and sums of 0/1 flags are integers, so a rate ``sum * 100 / count`` is a
rational number.  Computing it in DECIMAL keeps it exact, so ROUND half-up
gives the same digits the SQL standard's exact NUMERIC arithmetic gives, and
ties are never decided by a binary floating-point representation.  The
quotient is formed from narrow operands (DECIMAL(20,0) counts, DECIMAL(24,4)
sums) *before* any scaling, so Spark keeps 18 fractional digits (14 after a
x100 scaling); a rounded rate or mean is then exact for groups of up to about
10^12 rows.  Every
output is cast to DOUBLE last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COUNT_DECIMAL = "decimal(20,0)"
# sums of metrics with up to four decimals
_SUM_DECIMAL = "decimal(24,4)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(c: Column | str) -> Column:
    """Boolean flag as 0/1 integer (NULL stays NULL)."""
    return _col(c).cast("int")


def exact_ratio(numerator: Column | str, denominator: Column | str, scale: int = 1) -> Column:
    """``numerator * scale / denominator`` as an exact DECIMAL (NULL if denominator is 0).

    ``numerator`` may carry up to four decimals (a sum of a one- or
    two-decimal metric); ``denominator`` is a count.
    """
    quotient = F.try_divide(_col(numerator).cast(_SUM_DECIMAL), _col(denominator).cast(_COUNT_DECIMAL))
    return quotient if scale == 1 else quotient * F.lit(scale).cast(f"decimal({len(str(scale))},0)")


def round_ratio(numerator: Column | str, denominator: Column | str, digits: int, scale: int = 1) -> Column:
    """ROUND(numerator * scale / denominator, digits), half away from zero, as DOUBLE."""
    return F.round(exact_ratio(numerator, denominator, scale), digits).cast("double")


def half_even_ratio(numerator: Column | str, denominator: Column | str, digits: int, scale: int = 1) -> Column:
    """numerator * scale / denominator, rounded half to even, as DOUBLE (the report's segment rates)."""
    return F.bround(exact_ratio(numerator, denominator, scale), digits).cast("double")


def rate_pct(churned: Column | str, total: Column | str, digits: int = 2) -> Column:
    """Churn rate in percent, ``ROUND(churned * 100 / total, digits)``."""
    return round_ratio(churned, total, digits, scale=100)


def exact_mean(c: Column | str, digits: int) -> Column:
    """Rounded mean of a numeric column (NULLs skipped) computed as exact sum / count."""
    col = _col(c)
    total = F.sum(col.cast(_SUM_DECIMAL)).cast(_SUM_DECIMAL)
    n = F.count(col).cast(_COUNT_DECIMAL)
    return F.round(F.try_divide(total, n), digits).cast("double")
