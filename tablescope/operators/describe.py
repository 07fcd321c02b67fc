"""Descriptive statistics and scalar metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablescope.functions.columns import (
    clean,
    col,
    columns_of,
    number,
    numeric_columns,
    require_columns,
    require_numeric,
)
from tablescope.functions.dates import as_timestamp
from tablescope.functions.numbers import share
from tablescope.operators.order_stats import quantiles


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n, mean, std, min, max, total`` for numeric columns, in one aggregate."""
    columns = require_columns(df, columns)
    wide = df.select(*[number(df, c).alias(c) for c in columns]).agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(col(c)).alias("n"),
                F.avg(col(c)).alias("mean"),
                F.stddev_samp(col(c)).alias("std"),
                F.min(col(c)).alias("min"),
                F.max(col(c)).alias("max"),
                F.sum(col(c)).alias("total"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Count, mean, sample std, min, quartiles (exact, or estimated from sketches) and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    moments = column_moments(df, columns).drop("total")
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75], approx).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    # both sides hold one row per column
    return moments.join(F.broadcast(quartiles), "column", "left").select(
        "column", "n", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, most frequent value (ties: smallest) and its count."""
    columns = list(columns or columns_of(df, "categorical"))
    require_columns(df, columns)
    values = df.select(*[clean(df, c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = values.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("unique_values"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def _metric(df: DataFrame, column: str, name: str, expr) -> DataFrame:
    return df.agg(expr.alias("value")).select(F.lit(f"{name} {column}").alias("title"), "value")


def metric_average(df: DataFrame, column: str) -> DataFrame:
    require_numeric(df, column)
    return _metric(df, column, "Average", F.avg(number(df, column)))


def metric_sum(df: DataFrame, column: str) -> DataFrame:
    require_numeric(df, column)
    return _metric(df, column, "Total", F.coalesce(F.sum(clean(df, column)), F.lit(0)))


def metric_max(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return _metric(df, column, "Maximum", F.max(clean(df, column)))


def metric_min(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return _metric(df, column, "Minimum", F.min(clean(df, column)))


def metric_count(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, [column])
    return _metric(df, column, "Count of", F.count(clean(df, column)))


def monthly_trend(df: DataFrame, date_column: str, value_column: str) -> DataFrame:
    """Sum per calendar month, only months with data, in order."""
    require_numeric(df, value_column)
    return (
        df.where(col(date_column).isNotNull() & col(value_column).isNotNull())  # reaches the scan
        .select(as_timestamp(df, date_column).alias("stamp"), number(df, value_column).alias("value"))
        .where("stamp IS NOT NULL AND value IS NOT NULL")
        .groupBy(F.trunc(F.to_date("stamp"), "month").alias("month"))
        .agg(F.sum("value").alias("value"))
        .orderBy("month")
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and share of all labelled rows, most frequent first."""
    require_columns(df, [column])
    counts = (
        df.select(clean(df, column).alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", share(F.col("n"), total).alias("pct")).orderBy(F.desc("n"), "label")


def filter_preview(df: DataFrame, column: str, values: Sequence, order_by: Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows, in key order, whose column holds one of the values."""
    require_columns(df, [column, *order_by])
    return df.where(col(column).isin(*values)).orderBy(*[col(c) for c in order_by]).limit(rows)
