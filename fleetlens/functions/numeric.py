"""Numeric helpers: integer division, exact decimal ratios, guarded ratios."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def _trunc_div(a: Column, b: Column) -> Column:
    """Exact integral quotient of non-negative decimals: (a - a % b) / b."""
    return ((a - a % b) / b).cast("decimal(38,0)")


def int_div(num, den) -> Column:
    """T-SQL ``int / int``: truncates toward zero; NULL when ``den = 0``.

    Spark's integral ``div`` has exactly these semantics on longs (and is
    only evaluated on the non-zero branch, so ANSI mode does not raise)."""
    n, d = col_of(num).cast("long"), col_of(den).cast("long")
    return F.when(d != 0, F.call_function("div", n, d))


def exact_ratio(num, den, scale: int = 2, factor: int = 1, precision: int = 28) -> Column:
    """``CAST(num * factor / den AS DECIMAL(precision, scale))``, computed exactly.

    Integer operands.  The true quotient is rounded half away from zero at
    ``scale`` digits in one step, with no intermediate rounding, so the result
    is the exact decimal cast.  ``den = 0`` gives NULL.
    """
    n = col_of(num).cast("decimal(38,0)") * F.lit(factor * 10 ** scale).cast("decimal(38,0)")
    d = col_of(den).cast("decimal(38,0)")
    two = F.lit(2).cast("decimal(38,0)")
    q = _trunc_div(two * F.abs(n) + F.abs(d), two * F.abs(d))
    signed = (F.signum(n) * F.signum(d)).cast("decimal(38,0)") * q
    # multiply by 10^-scale (not divide: Spark caps a quotient's scale at 6)
    unit = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({max(scale, 1)},{scale})")
    scaled = signed.cast("decimal(30,0)") * unit
    return F.when(d != 0, scaled.cast(f"decimal({precision},{scale})"))


def safe_ratio(num, den, default=None, whole: bool = False) -> Column:
    """``CASE WHEN den = 0 THEN default ELSE num / den END``.

    ``default=None`` gives NULL for a zero divisor (``try_divide``); a number
    reproduces the reference's ``THEN 0`` guard.  ``whole`` divides integers as T-SQL does
    (:func:`int_div`), to a long.
    """
    n, d = col_of(num), col_of(den)
    q = int_div(n, d) if whole else F.try_divide(n, d)
    if default is None:
        return q
    return F.when(d == 0, F.lit(default).cast("long") if whole else F.lit(default)).otherwise(q)


def rounded_key(num, divisor: int, scale: int = 2) -> Column:
    """Ordering key equal to ``exact_ratio(num, divisor, scale)`` for a
    constant divisor, in plain long arithmetic (codegen'd, no BigDecimal):
    ``round_half_away(num * 10^scale / divisor)``.  Used to rank the whole
    table; the decimal itself is computed only for the rows that survive."""
    d = divisor
    for _ in range(scale):
        if d % 10 == 0:
            d //= 10
        else:
            raise ValueError("divisor must be a multiple of 10^scale")
    n = col_of(num).cast("long")
    # (2|n| + d) div 2d, exact in longs: Spark's ``div`` on integrals is integer division
    half_up = _long_div(F.abs(n) * 2 + d, 2 * d)
    return F.when(n >= 0, half_up).otherwise(-half_up)


def _long_div(a: Column, b: int) -> Column:
    """Integer division of a long column by a positive constant."""
    return F.call_function("div", a, F.lit(b).cast("long"))
