"""Column families, missing values and argument checks.

Numeric means integral, floating or decimal (never boolean); categorical means
string or boolean; datetime means date or timestamp; everything else is
"other" and takes no part in statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, *families: str) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) in families]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def non_numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "categorical", "datetime", "other")


def require_columns(df: DataFrame, names: Sequence[str], least: int = 1) -> list[str]:
    names = list(names)
    if len(names) < least:
        raise ValueError(f"select at least {least} column(s)")
    if len(set(names)) != len(names):
        raise ValueError(f"column names repeat: {names}")
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"no such column: {absent}; have {df.columns}")
    return names


def require_numeric(df: DataFrame, *names: str) -> None:
    require_columns(df, names)
    for name in names:
        if family(df.schema[name].dataType) != "numeric":
            raise ValueError(f"column {name!r} is not numeric")


def require_key(df: DataFrame, key: str | Sequence[str]) -> list[str]:
    return require_columns(df, [key] if isinstance(key, str) else key)


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that one test finds both."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, NaN as NULL and no negative zero."""
    return clean(df, name).cast("double") + F.lit(0.0)


def clean_frame(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return df.select(*[clean(df, n).alias(n) for n in (names or df.columns)])


def cell(df: DataFrame, name: str) -> Column:
    """A value of any type as one comparable struct, NULL when missing.

    Keeping numbers as numbers avoids formatting every value as text, and one
    common type lets a single unpivot carry all columns of a table.
    """
    dtype = df.schema[name].dataType
    c = clean(df, name)
    whole = real = text = None
    if isinstance(dtype, T.IntegralType):
        whole = c.cast("bigint")
    elif isinstance(dtype, T.BooleanType):
        whole = c.cast("int").cast("bigint")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        real = c.cast("double")
    elif isinstance(dtype, T.DateType):
        whole = F.unix_date(c).cast("bigint")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.unix_micros(c.cast("timestamp"))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(c)
    else:
        text = c.cast("string")
    packed = F.struct(
        (whole if whole is not None else F.lit(None).cast("bigint")).alias("whole"),
        (real if real is not None else F.lit(None).cast("double")).alias("real"),
        (text if text is not None else F.lit(None).cast("string")).alias("text"),
    )
    return F.when(c.isNotNull(), packed)


def groupable(df: DataFrame) -> DataFrame:
    """The frame with NaN as NULL and maps as JSON, so that rows can be grouped."""
    out = []
    for f in df.schema.fields:
        c = F.to_json(col(f.name)) if isinstance(f.dataType, T.MapType) else clean(df, f.name)
        out.append(c.alias(f.name))
    return df.select(*out)


def literal_rows(spark: SparkSession, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """A small constant table (column names, thresholds) made of literals only."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put the columns of a one-row frame next to every row of another.

    The right side must be a global aggregate: it is read as a scalar subquery,
    so the left side is neither shuffled nor multiplied.
    """
    packed = right.select(F.struct("*").alias("beside_row")).scalar()
    wide = left.select("*", packed.alias("beside_row"))
    return wide.select(*left.columns, *[F.col("beside_row")[n].alias(n) for n in right.columns])
