"""Missing values: NULL is the only one. NaN becomes NULL, infinities stay values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nn(x: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def fin(x: Column) -> Column:
    """x where finite; what enters rolling operators."""
    return F.when(F.abs(nn(x)) < INF, x)


def div(x: Column, y: Column) -> Column:
    """x / y with signed infinities for a zero divisor and NULL for 0 / 0."""
    return F.when(y == 0, F.when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF))).otherwise(nn(x / F.when(y != 0, y)))


def div0(x: Column, y: Column) -> Column:
    """x / y, NULL for a zero divisor."""
    return x / F.when(y != 0, y)


def both(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def truth(c: Column, boolean: bool) -> Column:
    """A condition: a missing number counts as true, a missing boolean as false."""
    return F.coalesce(c, F.lit(False)) if boolean else F.coalesce(c != 0, F.lit(True))
