"""Quantile sketches that are kept and merged: per table, per day, over all of them.

A sketch is a small binary value.  Sketches of parts of the data merge to a
sketch of the whole, so a stored one saves reading the rows again.  An estimated
quantile is one of the values, at a rank that is off by at most ``RANK_ERROR`` of
the rows with a confidence of 99 %.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablescope.functions.columns import col, number, require_columns

SIZE = 4096  # k of the sketch
RANK_ERROR = 0.002


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., column, n, min, max, sketch``: one row per column with values, from one scan that shuffles sketches only."""
    columns = require_columns(df, columns)
    wide = df.select(*[col(b) for b in by], *[number(df, c).alias(f"__v{i}") for i, c in enumerate(columns)])
    cells = []
    for i, c in enumerate(columns):
        v = F.col(f"__v{i}")
        sketch = F.kll_sketch_agg_double(v, SIZE)
        facts = {"column": F.lit(c), "n": F.count(v), "min": F.min(v), "max": F.max(v), "sketch": sketch}
        cells.append(F.struct(*[e.alias(name) for name, e in facts.items()]).alias(f"__c{i}"))
    found = wide.groupBy(*by).agg(*cells) if by else wide.agg(*cells)
    return found.select(*[col(b) for b in by], F.inline(F.array(*[F.col(f"__c{i}") for i in range(len(columns))]))).where("n > 0")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of one column, and equal ``by`` columns, merged to one; a union of stored tables is merged this way."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", SIZE).alias("sketch")
    )


def quantiles_of(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The other columns and ``q0, q1, ...``: the estimated quantile at each probability, the extremes exactly."""

    def at(p: float) -> Column:
        if p in (0, 1):
            return F.col("min" if p == 0 else "max")
        return F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))

    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*[col(c) for c in kept], *[at(p).alias(f"q{i}") for i, p in enumerate(probs)])
