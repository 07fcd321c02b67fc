"""Data-quality audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablescope.functions.columns import beside, number, numeric_columns
from tablescope.functions.labels import missing_flag, score_band
from tablescope.functions.numbers import share
from tablescope.operators.order_stats import quantiles
from tablescope.operators.profile import missing_cells, missing_distribution, row_copies, table_stats


def completeness(df: DataFrame) -> DataFrame:
    """Missing share of all cells and the completeness score (100 for no cells)."""
    return missing_cells(df).select(
        "missing_cells",
        "missing_pct",
        F.greatest(F.lit(0.0), 100 - F.col("missing_pct")).alias("completeness"),
        missing_flag(F.col("missing_pct")).alias("alert"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    return missing_distribution(df)


def consistency(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, their share, and the consistency score."""
    pct = share(F.col("duplicate_rows"), F.col("n_rows"), empty=0.0)
    return table_stats(df).select(
        "duplicate_rows", pct.alias("duplicate_pct"), F.greatest(F.lit(0.0), 100 - pct).alias("consistency")
    )


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Every row that occurs more than once, once, with its number of copies."""
    return row_copies(df).where("copies > 1").drop("missing_in_row")


def iqr_audit(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, approx: bool = False
) -> DataFrame:
    """Quartile fences and the number of values outside them, for every numeric column.

    The quartiles, one row per column, are read first; counting is then one
    plain aggregate with the fences as literals.  ``approx=True`` estimates the
    quartiles from sketches; the values outside the fences are counted all the same.
    """
    columns = list(columns or numeric_columns(df))
    quartiles = quantiles(df, columns, [0.25, 0.75], approx).collect()
    rows = df.select(*[number(df, r["column"]).alias(f"v{i}") for i, r in enumerate(quartiles)])
    aggregates, out = [], []
    for i, r in enumerate(quartiles):
        spread = factor * (r["q1"] - r["q0"])
        low, high = r["q0"] - spread, r["q1"] + spread
        value = F.col(f"v{i}")
        aggregates.append(F.count(F.when((value < low) | (value > high), 1)).alias(f"o{i}"))
        facts = {
            "column": F.lit(r["column"]),
            "non_null": F.lit(r["n"]).cast("bigint"),
            "q1": F.lit(r["q0"]),
            "q3": F.lit(r["q1"]),
            "lower_bound": F.lit(low),
            "upper_bound": F.lit(high),
            "outliers": F.col(f"o{i}"),
            "outlier_pct": share(F.col(f"o{i}"), F.lit(r["n"])),
            "min_value": F.lit(r["min"]),
            "max_value": F.lit(r["max"]),
        }
        out.append(F.struct(*[c.alias(name) for name, c in facts.items()]))
    if not out:
        return df.sparkSession.createDataFrame([], AUDIT_SCHEMA)
    return rows.agg(*aggregates).select(F.inline(F.array(*out)))


AUDIT_SCHEMA = (
    "column string, non_null bigint, q1 double, q3 double, lower_bound double, upper_bound double, "
    "outliers bigint, outlier_pct double, min_value double, max_value double"
)


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, approx: bool = False
) -> DataFrame:
    """Numeric columns that hold values outside the quartile fences, worst first."""
    return iqr_audit(df, columns, factor, approx).where("outliers > 0").orderBy(F.desc("outlier_pct"), "column")


def outlier_health(df: DataFrame) -> DataFrame:
    """Outlying share of all non-null numeric cells and the score 100 - share."""
    columns = numeric_columns(df)
    if not columns:
        totals = df.agg(F.lit(0).cast("bigint").alias("numeric_cells"), F.lit(0).cast("bigint").alias("outlier_cells"))
    else:
        totals = iqr_audit(df, columns).agg(
            F.coalesce(F.sum("non_null"), F.lit(0)).alias("numeric_cells"),
            F.coalesce(F.sum("outliers"), F.lit(0)).alias("outlier_cells"),
        )
    risk = share(F.col("outlier_cells"), F.col("numeric_cells"), empty=0.0)
    return totals.select(
        "numeric_cells",
        "outlier_cells",
        risk.alias("outlier_risk"),
        F.greatest(F.lit(0.0), 100 - risk).alias("outlier_health"),
    )


def overall_health(df: DataFrame) -> DataFrame:
    """All scores (1 dp), their weighted overall score and its band."""
    stats = table_stats(df)
    scores = beside(stats, outlier_health(df)).select(
        "n_rows",
        "missing_cells",
        "duplicate_rows",
        "outlier_cells",
        F.round(F.greatest(F.lit(0.0), 100 - F.col("missing_pct")), 1).alias("completeness"),
        F.round(
            F.greatest(F.lit(0.0), 100 - share(F.col("duplicate_rows"), F.col("n_rows"), empty=0.0)), 1
        ).alias("consistency"),
        F.round("outlier_health", 1).alias("outlier_health"),
        F.round("outlier_risk", 1).alias("outlier_risk"),
    )
    # fixed values: weights 0.40, 0.30, 0.30
    overall = F.round(
        F.col("completeness") * 0.40 + F.col("consistency") * 0.30 + F.col("outlier_health") * 0.30, 1
    )
    return scores.withColumn("overall", overall).withColumn("band", score_band(F.col("overall")))
