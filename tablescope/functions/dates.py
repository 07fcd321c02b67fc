"""Date parsing, calendar periods and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# fixed values: text layouts accepted as dates, tried in this order
DATE_LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy/MM/dd[ HH:mm:ss]",
    "MM/dd/yyyy[ HH:mm:ss]",
    "M/d/yyyy",
    "MM-dd-yyyy",
    "dd.MM.yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
]

FREQUENCIES = ("D", "W", "M")


def parse_timestamp(text: Column) -> Column:
    """Parse mixed date layouts; what fits none of them becomes NULL.

    The plain cast accepts ISO text; bare numbers such as ``2024`` or ``17`` are
    not taken for dates unless they have eight digits.
    """
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(F.trim(text), F.lit(layout)) for layout in DATE_LAYOUTS])


def as_timestamp(df, name: str) -> Column:
    """A date column of any type as zone-free timestamp, unparsable text as NULL."""
    dtype = df.schema[name].dataType
    c = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.StringType):
        return parse_timestamp(c).cast("timestamp_ntz")
    if isinstance(dtype, (T.DateType, T.TimestampType)):
        return c.cast("timestamp_ntz")
    raise ValueError(f"column {name!r} holds no dates")


def period_of(stamp: Column, freq: str) -> Column:
    """Start key of the period: the day, the Monday, or the first of the month."""
    day = F.to_date(stamp)
    if freq == "D":
        return day
    if freq == "W":
        return F.trunc(day, "week").cast("date")
    if freq == "M":
        return F.trunc(day, "month").cast("date")
    raise ValueError(f"freq must be one of {FREQUENCIES}, not {freq!r}")


def period_label(start: Column, freq: str) -> Column:
    """Shown date of a period: the day, the closing Sunday, or the month's last day."""
    if freq == "W":
        return F.date_add(start, 6)
    if freq == "M":
        return F.last_day(start)
    return start


def period_step(freq: str) -> Column:
    return F.expr({"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH"}[freq])


def calendar_features(label: Column, first: Column) -> list[Column]:
    """Days since the first period, weekday (Monday = 0), month, quarter."""
    return [
        F.datediff(label, first).cast("double").alias("days_since"),
        F.weekday(label).cast("double").alias("day_of_week"),
        F.month(label).cast("double").alias("month"),
        F.quarter(label).cast("double").alias("quarter"),
    ]
