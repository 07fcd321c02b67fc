"""Verbal bands over scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def score_band(score: Column) -> Column:
    """Health band of a 0-100 score."""
    # fixed values: 80 and 50 are the band edges
    return F.when(score >= 80, "Excellent").when(score >= 50, "Fair (Warning)").otherwise("Critical Danger")


def strength_label(r: Column) -> Column:
    """Strength and direction of a correlation coefficient."""
    # fixed values: 0.7 and 0.4
    size = F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate").otherwise("weak")
    sign = F.when(r > 0, "positive").otherwise("negative")
    return F.when(r.isNotNull(), F.concat_ws(" ", size, sign))


def severity_label(severity: Column) -> Column:
    """Verbal level of a 1-100 severity."""
    # fixed values: 80 and 50
    return F.when(severity > 80, "CRITICAL").when(severity > 50, "HIGH").otherwise("MEDIUM")


def missing_flag(missing_pct: Column) -> Column:
    """True where more than 5 % of the cells are missing."""
    return F.coalesce(missing_pct > 5, F.lit(False))
