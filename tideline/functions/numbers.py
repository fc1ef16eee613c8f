"""Rounding and small numeric helpers (Q6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: the same double in every engine, unlike
    ``round``. Digits 0 gives the console's rounding as a double."""
    if digits == 0:
        return F.floor(x + F.lit(0.5)).cast("double")
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def truthy(x: Column) -> Column:
    """Null and zero are 'no amount'."""
    return x.isNotNull() & (x != 0)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
