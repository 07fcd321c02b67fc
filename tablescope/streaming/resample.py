"""Period sums over a stream, equal to the batch resampling once all rows have arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablescope.functions.dates import period_label, period_of
from tablescope.operators.series import coerce_datetime


def resample_stream(stream: DataFrame, date_column: str, value_column: str, freq: str = "D", by=None) -> DataFrame:
    """``by..., period, value`` per period seen so far, for ``update`` or ``complete`` output.

    State is one running sum per series and period.  Empty periods are filled by
    the reader of the sink, who knows where the calendar ends.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    rows = coerce_datetime(stream, date_column, value_column, by)
    sums = rows.groupBy(*by, period_of(F.col("stamp"), freq).alias("start")).agg(F.sum("value").alias("value"))
    return sums.select(*by, period_label(F.col("start"), freq).alias("period"), "value")
