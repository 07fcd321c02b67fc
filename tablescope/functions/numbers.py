"""Arithmetic helpers that survive zero denominators and constant columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def share(part: Column, whole: Column, scale: float = 100.0, empty: float | None = None) -> Column:
    """``part / whole * scale``; ``empty`` when the denominator is zero."""
    value = F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(scale)
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def clamp(value: Column, low: float, high: float) -> Column:
    """The value kept within the bounds; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value)))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over the complete pairs, NULL if either is constant.

    Built from covariance and standard deviations because the built-in raises on
    a constant column when ANSI mode is on.
    """
    sx = F.stddev_pop(F.when(y.isNotNull(), x))
    sy = F.stddev_pop(F.when(x.isNotNull(), y))
    return clamp(F.try_divide(F.covar_pop(x, y), sx * sy), -1, 1)


def zero_as(value: Column, replacement: float) -> Column:
    """Replace an exact zero (a constant column's deviation)."""
    return F.when(value == 0, F.lit(float(replacement))).otherwise(value)
