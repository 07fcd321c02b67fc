"""What kind of table is this: a catalogue of columns, classified table by table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablescope.functions.columns import clean, family, literal_rows
from tablescope.functions.numbers import clamp
from tablescope.operators.profile import text_date_columns

# fixed values: keywords looked for in column names
CUSTOMER = ["customer", "user", "client", "age", "gender", "email", "name", "account_id", "subscriber"]
FINANCIAL = ["revenue", "profit", "cost", "price", "salary", "tax", "margin", "income", "expense"]
TRANSACTION = ["transaction", "order", "product", "quantity", "amount", "purchase", "cart", "invoice"]

# fixed values: recommended analyses by kind of table
MODULES = {
    "Transaction Dataset": ["Correlation Discovery", "Segment Discovery", "Semantic Data Map"],
    "Financial Dataset": ["Anomaly Detection", "Correlation Discovery", "Executive Dashboard"],
    "Customer Dataset": ["Segment Discovery", "Dataset DNA Profile", "Semantic Data Map"],
    "General Tabular Dataset": ["Dataset DNA Profile", "Explorer Dashboard", "Correlation Discovery"],
    "Time Series Dataset": ["Timeline Intelligence", "Future Forecasting", "Anomaly Detection"],
}


def schema_catalogue(tables: Mapping[str, DataFrame], text_dates: bool = False) -> DataFrame:
    """``table, column, dtype, family, is_date`` from the schemas alone; no table is read.

    With ``text_dates`` the string columns are read, and those whose values all
    parse as dates count as dates.
    """
    rows = []
    for name, df in tables.items():
        dated = text_date_columns(df) if text_dates else []
        for f in df.schema.fields:
            kind = family(f.dataType)
            values = (name, f.name, f.dataType.simpleString(), kind, kind == "datetime" or f.name in dated)
            rows.append([F.lit(v) for v in values])
    spark = next(iter(tables.values())).sparkSession
    return literal_rows(spark, rows, ["table", "column", "dtype", "family", "is_date"])


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, n_rows``; counting reads no column."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, counts)


def column_catalogue(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table, column, dtype, family, n_rows, non_null`` for all columns of many tables.

    One narrow aggregate per table; each shuffles a single row per task.
    """
    frames = []
    for name, df in tables.items():
        counts = df.agg(
            F.count("*").alias("n_rows"), *[F.count(clean(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
        )
        rows = F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("table"),
                        F.lit(f.name).alias("column"),
                        F.lit(f.dataType.simpleString()).alias("dtype"),
                        F.lit(family(f.dataType)).alias("family"),
                        F.col("n_rows").alias("n_rows"),
                        F.col(f"c{i}").alias("non_null"),
                    )
                    for i, f in enumerate(df.schema.fields)
                ]
            )
        )
        frames.append(counts.select(rows))
    return reduce(DataFrame.unionAll, frames)


def _hits(words: list[str]) -> Column:
    return F.sum(F.when(F.lower("column").rlike("|".join(words)), 1).otherwise(0))


def catalog_profile(tables: Mapping[str, DataFrame], text_dates: bool = False) -> DataFrame:
    """Per table: rows, columns, kind of table and up to three recommended analyses.

    Ties go to transaction, then financial, then customer; tables with a date
    column are temporal, with ``text_dates`` one in text as well.
    """
    scored = schema_catalogue(tables, text_dates).groupBy("table").agg(
        F.count("*").alias("n_columns"),
        _hits(CUSTOMER).alias("customer_hits"),
        _hits(FINANCIAL).alias("financial_hits"),
        _hits(TRANSACTION).alias("transaction_hits"),
        F.max("is_date").alias("has_date"),
    )
    best = F.greatest("customer_hits", "financial_hits", "transaction_hits")
    base = (
        F.when((best == 0) & F.col("has_date"), "Time Series Dataset")
        .when(best == 0, "General Tabular Dataset")
        .when(F.col("transaction_hits") == best, "Transaction Dataset")
        .when(F.col("financial_hits") == best, "Financial Dataset")
        .otherwise("Customer Dataset")
    )
    temporal = F.col("has_date") & (best > 0)
    modules = F.lit(None).cast("array<string>")
    for kind, names in MODULES.items():
        modules = F.when(F.col("base") == kind, F.array(*[F.lit(n) for n in names])).otherwise(modules)
    shown = F.slice(F.when(temporal, F.concat(F.array(F.lit("Timeline Intelligence")), modules)).otherwise(modules), 1, 3)
    return scored.join(row_counts(tables), "table").withColumn("base", base).select(
        "table",
        "n_rows",
        "n_columns",
        F.when(temporal, F.concat(F.lit("Temporal "), F.col("base"))).otherwise(F.col("base")).alias("dataset_type"),
        F.array_join(shown, ", ").alias("modules"),
    )


def richness_score(catalogue: DataFrame) -> DataFrame:
    """Per table of a schema catalogue: variety of column types (entropy over its maximum) plus a bonus for many columns."""
    total = F.count("*").cast("double")
    shares = [
        F.sum(F.when(F.col("family") == "numeric", 1.0).otherwise(0.0)) / total,
        F.sum(F.when(F.col("family").isin("categorical", "other"), 1.0).otherwise(0.0)) / total,
        F.sum(F.when(F.col("family") == "datetime", 1.0).otherwise(0.0)) / total,
    ]
    entropy = -sum((F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)) for p in shares), F.lit(0.0))
    # fixed values: 1.098, weight 0.7, 1.5 per column up to 30
    score = entropy / 1.098 * 100 * 0.7 + F.least(F.lit(30.0), total * 1.5)
    return catalogue.groupBy("table").agg(F.round(clamp(score, 0, 100), 1).alias("richness"))
