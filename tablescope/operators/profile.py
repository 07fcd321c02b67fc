"""Schema and column profiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablescope.functions.columns import (
    cell,
    clean,
    col,
    columns_of,
    groupable,
    literal_rows,
    non_numeric_columns,
    numeric_columns,
    require_columns,
)
from tablescope.functions.dates import parse_timestamp
from tablescope.functions.numbers import share


def row_copies(df: DataFrame) -> DataFrame:
    """Distinct rows with ``copies`` and ``missing_in_row``; copies collapse before the shuffle."""
    rows = groupable(df)
    gaps = sum((F.when(col(c).isNull(), 1).otherwise(0) for c in rows.columns), F.lit(0))
    return rows.groupBy(*[col(c) for c in rows.columns]).agg(F.count("*").alias("copies")).withColumn("missing_in_row", gaps)


def row_digests(df: DataFrame) -> DataFrame:
    """``copies, missing_in_row`` per distinct row, told apart by two 64-bit hashes of its values and gaps."""
    rows = groupable(df)
    columns = [col(c) for c in rows.columns]
    gaps = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    hashed = rows.select(
        F.xxhash64(gaps, *columns).alias("first"),
        F.xxhash64(F.lit(1), *reversed(columns), gaps).alias("second"),
        F.length(F.replace(gaps, F.lit("0"), F.lit(""))).alias("missing_in_row"),
    )
    return hashed.groupBy("first", "second", "missing_in_row").agg(F.count("*").alias("copies"))


def missing_cells(df: DataFrame) -> DataFrame:
    """One row ``n_rows, missing_cells, missing_pct``: counted where the rows are read, nothing is shuffled but sums."""
    filled = sum((F.count(clean(df, c)) for c in df.columns), F.lit(0).cast("bigint"))
    counts = df.agg(F.count("*").alias("n_rows"), filled.alias("filled"))
    cells = F.col("n_rows") * len(df.columns)
    missing = cells - F.col("filled")
    return counts.select("n_rows", missing.alias("missing_cells"), share(missing, cells, empty=0.0).alias("missing_pct"))


def table_stats(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, missing cells and share, duplicate rows, columns by family.

    Only hashes of the rows are shuffled.
    """
    width = len(df.columns)
    totals = row_digests(df).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("copies") * F.col("missing_in_row")), F.lit(0)).alias("missing_cells"),
    )
    cells = F.col("n_rows") * width
    return totals.select(
        "n_rows",
        F.lit(width).cast("bigint").alias("n_columns"),
        cells.alias("total_cells"),
        "missing_cells",
        share(F.col("missing_cells"), cells, empty=0.0).alias("missing_pct"),
        (F.col("n_rows") - F.col("distinct_rows")).alias("duplicate_rows"),
        *[
            F.lit(len(columns_of(df, name))).cast("bigint").alias(f"{name}_columns")
            for name in ("numeric", "categorical", "datetime", "other")
        ],
    )


def _column_names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [
        [F.lit(i).cast("int"), F.lit(c), F.lit(df.schema[c].dataType.simpleString())] for i, c in enumerate(columns)
    ]
    return literal_rows(df.sparkSession, rows, ["position", "column", "dtype"])


def schema_profile(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column: type, non-null count, nulls, null share, distinct values.

    One scan: all columns are unpivoted to a common cell type and grouped twice,
    first by value, then by column; both steps combine where the rows are read.
    Texts are represented by 128-bit digests, so none is shuffled.
    ``approx=True`` sketches the distinct counts and shuffles nothing but sketches.
    """
    columns = require_columns(df, columns or df.columns)
    cells = df.select(*[cell(df, c).alias(c) for c in columns]).unpivot([], columns, "column", "value")
    if approx:
        found = cells.groupBy("column").agg(
            F.count("*").alias("n_rows"),
            F.count("value").alias("non_null"),
            F.approx_count_distinct("value").alias("distinct_values"),
        )
    else:
        digest = F.unhex(F.md5(F.col("value.text").cast("binary"))).alias("digest")
        short = F.when(F.col("value").isNotNull(), F.struct("value.whole", "value.real", digest))
        found = (
            cells.select("column", short.alias("value"))
            .groupBy("column", "value")
            .agg(F.count("*").alias("n"))
            .groupBy("column")
            .agg(
                F.sum("n").alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
                F.count("value").alias("distinct_values"),
            )
        )
    zero = F.lit(0).cast("bigint")
    return (
        _column_names(df, columns)
        .join(F.broadcast(found), "column", "left")  # one row per column
        .select(
            "position",
            "column",
            "dtype",
            F.coalesce("non_null", zero).alias("non_null"),
            F.coalesce(F.col("n_rows") - F.col("non_null"), zero).alias("nulls"),
            share(F.col("n_rows") - F.col("non_null"), F.col("n_rows"), empty=0.0).alias("null_pct"),
            F.coalesce("distinct_values", zero).alias("distinct_values"),
        )
        .orderBy("position")
    )


def missing_distribution(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and share (1 dp), most missing first.

    A plain count per column; no grouping by value is needed.
    """
    counts = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count(clean(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(c).alias("column"),
                    (F.col("n_rows") - F.col(f"c{i}")).alias("missing_count"),
                    F.round(share(F.col("n_rows") - F.col(f"c{i}"), F.col("n_rows")), 1).alias("missing_pct"),
                )
                for i, c in enumerate(df.columns)
            ]
        )
    )
    return counts.select(rows).where("missing_count > 0").orderBy(F.desc("missing_count"), "position").drop("position")


def text_date_columns(df: DataFrame) -> list[str]:
    """String columns with values that all parse as dates; one aggregate over all values of all of them."""
    strings = [c for c in columns_of(df, "categorical") if df.schema[c].dataType.typeName() == "string"]
    if not strings:
        return []
    values = [clean(df, c).cast("string") for c in strings]
    seen = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.count(parse_timestamp(v)).alias(f"d{i}") for i, v in enumerate(values)],
    ).first()
    return [c for i, c in enumerate(strings) if seen[f"n{i}"] > 0 and seen[f"n{i}"] == seen[f"d{i}"]]


def detect_date_columns(df: DataFrame) -> list[str]:
    """Native date columns, then string columns whose values all parse as dates."""
    return columns_of(df, "datetime") + text_date_columns(df)


def primary_date_column(df: DataFrame) -> str | None:
    """The date column a question about time refers to, or None."""
    native = columns_of(df, "datetime")
    if native:
        return native[0]
    # fixed values: name hints
    hints = ["date", "time", "year", "month", "timestamp"]
    found = text_date_columns(df)
    return next((c for c in found if any(h in c.lower() for h in hints)), next(iter(found), None))


def low_cardinality_columns(df: DataFrame, limit: int = 30) -> list[str]:
    """Numeric columns, then other columns with fewer than ``limit`` distinct values."""
    others = non_numeric_columns(df)
    counts = small_cardinalities(df, others, limit - 1)
    return numeric_columns(df) + [c for c in others if counts[c] is not None]


def small_cardinalities(
    df: DataFrame, columns: Sequence[str], limit: int, sketched: bool = False
) -> dict[str, int | None]:
    """Exact distinct counts of columns with at most ``limit`` values, None for the others.

    A sketch first rules out columns far above the limit, so that the exact
    count shuffles only columns with few values.  The sketch counts small sets
    almost exactly, hence four times the limit is a safe margin.  ``sketched``
    says that the caller has ruled such columns out.
    """
    columns = list(columns)
    if not columns:
        return {}
    cells = df.select(*[cell(df, c).alias(c) for c in columns])
    near = columns
    if not sketched:
        sketch = cells.agg(*[F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        near = [c for i, c in enumerate(columns) if sketch[i] <= 4 * limit + 20]
    counts: dict[str, int | None] = dict.fromkeys(columns)
    if near:
        found = (
            cells.select(*[col(c) for c in near])
            .unpivot([], near, "column", "value")
            .where("value IS NOT NULL")
            .groupBy("column", "value")
            .count()
            .groupBy("column")
            .agg(F.count("*").alias("n"))
            .collect()
        )
        exact = dict.fromkeys(near, 0) | {r["column"]: r["n"] for r in found}
        counts.update({c: n for c, n in exact.items() if n <= limit})
    return counts
