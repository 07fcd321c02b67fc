"""Time series: resampling, trends, change events, anomalies, seasonality.

Raw rows are only ever grouped by (series, period), which combines map-side.
Windows run on the resampled series, whose length is bounded by the calendar,
and are partitioned by the series columns given in ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tablescope.functions.columns import col, number, require_columns, require_numeric
from tablescope.functions.dates import as_timestamp, period_label, period_of, period_step
from tablescope.functions.labels import severity_label
from tablescope.functions.numbers import clamp, share, zero_as


def _keys(by: str | Sequence[str] | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _in_order(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[col(b) for b in by]).orderBy("period")


def _whole(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[col(b) for b in by])


def coerce_datetime(df: DataFrame, date_column: str, value_column: str, by=None) -> DataFrame:
    """``by..., stamp, value`` with dates parsed; rows without date or value are dropped."""
    by = _keys(by)
    require_numeric(df, value_column)
    require_columns(df, [date_column, *by])
    present = df.where(col(date_column).isNotNull() & col(value_column).isNotNull())  # reaches the scan
    return present.select(
        *[col(b) for b in by], as_timestamp(df, date_column).alias("stamp"), number(df, value_column).alias("value")
    ).where("stamp IS NOT NULL AND value IS NOT NULL")


def resample_sum(df: DataFrame, date_column: str, value_column: str, freq: str = "D", by=None) -> DataFrame:
    """``by..., period, value``: sum per day, Sunday week or month end; empty periods are 0.

    Gaps are filled from each period to the next one present, so neither a
    calendar table nor a join is needed.
    """
    by = _keys(by)
    rows = coerce_datetime(df, date_column, value_column, by)
    sums = rows.groupBy(*[col(b) for b in by], period_of(F.col("stamp"), freq).alias("period")).agg(
        F.sum("value").alias("value")
    )
    following = F.lead("period").over(_in_order(by))
    step = period_step(freq)
    last = F.when(following.isNull(), F.col("period")).otherwise(F.to_date(following - step))
    filled = sums.withColumn("until", last).select(
        *[col(b) for b in by],
        F.col("period").alias("present"),
        "value",
        F.explode(F.sequence("period", "until", step)).alias("period"),
    )
    return filled.select(
        *[col(b) for b in by],
        period_label(F.col("period"), freq).alias("period"),
        F.when(F.col("period") == F.col("present"), F.col("value")).otherwise(F.lit(0.0)).alias("value"),
    )


def moving_average(series: DataFrame, window: int = 7, by=None) -> DataFrame:
    """Trailing mean over ``window`` periods, shorter at the start."""
    frame = _in_order(_keys(by)).rowsBetween(-(window - 1), 0)
    return series.withColumn("moving_avg", F.avg("value").over(frame))


def rolling_std(series: DataFrame, window: int = 7, by=None) -> DataFrame:
    """Trailing sample deviation over ``window`` periods, 0 where undefined."""
    frame = _in_order(_keys(by)).rowsBetween(-(window - 1), 0)
    return series.withColumn("rolling_std", F.coalesce(F.stddev_samp("value").over(frame), F.lit(0.0)))


def std_band(series: DataFrame, window: int = 7, by=None) -> DataFrame:
    """Moving average with a band of one rolling deviation on both sides."""
    both = rolling_std(moving_average(series, window, by), window, by)
    return both.withColumn("band_upper", F.col("moving_avg") + F.col("rolling_std")).withColumn(
        "band_lower", F.col("moving_avg") - F.col("rolling_std")
    )


def _numbered(series: DataFrame, by: Sequence[str]) -> DataFrame:
    return series.withColumn("row", F.row_number().over(_in_order(by))).withColumn(
        "periods", F.count("*").over(_whole(by))
    )


def trend_direction(series: DataFrame, window: int = 7, by=None) -> DataFrame:
    """Per series: least-squares slope of the moving average, relative slope, direction."""
    by = _keys(by)
    smooth = _numbered(moving_average(series, window, by), by)
    x = F.col("row").cast("double")
    fitted = smooth.groupBy(*[col(b) for b in by]).agg(
        F.count("*").alias("periods"),
        F.coalesce(F.try_divide(F.covar_pop("moving_avg", x), F.var_pop(x)), F.lit(0.0)).alias("slope"),
        F.avg("moving_avg").alias("level"),
    )
    relative = F.col("slope") / zero_as(F.col("level"), 1.0)
    # fixed values: 0.01 either way
    direction = F.when(relative > 0.01, "Increasing").when(relative < -0.01, "Decreasing").otherwise("Stable")
    return fitted.select(
        *by, "periods", "slope", relative.alias("relative_slope"), direction.alias("direction")
    )


def growth(series: DataFrame, window: int = 7, by=None) -> DataFrame:
    """Per series: mean of the last against the first ``window`` smoothed values, in percent."""
    by = _keys(by)
    smooth = _numbered(moving_average(series, window, by), by)
    span = F.when(F.col("periods") > window, F.lit(window)).otherwise(F.lit(1))
    ends = smooth.groupBy(*[col(b) for b in by]).agg(
        F.avg(F.when(F.col("row") <= span, F.col("moving_avg"))).alias("start_value"),
        F.avg(F.when(F.col("row") > F.col("periods") - span, F.col("moving_avg"))).alias("end_value"),
    )
    change = share(F.col("end_value") - F.col("start_value"), F.abs("start_value"), empty=0.0)
    return ends.withColumn("growth_pct", change)


def series_kpis(series: DataFrame, by=None) -> DataFrame:
    """Per series: peak value and its first date, total, number of periods."""
    return series.groupBy(*[col(b) for b in _keys(by)]).agg(
        F.max("value").alias("peak_value"),
        F.min_by("period", F.struct(-F.col("value"), F.col("period"))).alias("peak_period"),
        F.sum("value").alias("total"),
        F.count("*").alias("periods"),
    )


def change_zscore(series: DataFrame, window: int = 14, threshold: float = 2.5, by=None) -> DataFrame:
    """z of each period against the ``window`` periods before it, and whether it is a change.

    Series shorter than two windows give no rows.
    """
    by = _keys(by)
    before = _in_order(by).rowsBetween(-window, -1)
    z = (F.col("value") - F.avg("value").over(before)) / zero_as(F.stddev_samp("value").over(before), 1e-5)
    enough = F.count("value").over(before) >= window // 2
    return (
        series.withColumn("z_score", F.when(enough, z))
        .withColumn("is_change", F.coalesce(F.abs("z_score") > threshold, F.lit(False)))
        .withColumn("periods", F.count("*").over(_whole(by)))
        .where(F.col("periods") >= 2 * window)
        .drop("periods")
    )


def change_events(series: DataFrame, window: int = 14, threshold: float = 2.5, by=None) -> DataFrame:
    """Runs of consecutive changes: start, direction, strongest z, level before and after, shift.

    Levels are windows over the same order as the z-score, so one sort serves
    the whole operator and no join is needed.
    """
    by = _keys(by)
    order = _in_order(by)
    scored = (
        change_zscore(series, window, threshold, by)
        .withColumn("row", F.row_number().over(order))
        .withColumn("before", F.coalesce(F.avg("value").over(order.rowsBetween(-window, -1)), F.col("value")))
        .withColumn("ahead", F.avg("value").over(order.rowsBetween(0, window - 1)))
        .withColumn("after", F.lead("ahead").over(order))
        .withColumn("was_change", F.coalesce(F.lag("is_change").over(order), F.lit(False)))
        .withColumn(
            "run",
            F.sum(F.when(F.col("is_change") & ~F.col("was_change"), 1).otherwise(0)).over(
                order.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
    )
    events = scored.where("is_change").groupBy(*[col(b) for b in by], "run").agg(
        F.min("period").alias("start"),
        F.count("*").alias("length"),
        F.min_by("z_score", "row").alias("first_z"),
        F.max_by("z_score", F.struct(F.abs("z_score"), -F.col("row"))).alias("peak_z"),
        F.min_by("before", "row").alias("pre_baseline"),
        F.max_by(F.struct("after"), "row")["after"].alias("after"),
        F.avg("value").alias("own_level"),
    )
    post = F.coalesce(F.col("after"), F.col("own_level"))
    return events.select(
        *by,
        "start",
        "length",
        F.when(F.col("first_z") > 0, "Spike").otherwise("Drop").alias("direction"),
        "peak_z",
        "pre_baseline",
        post.alias("post_baseline"),
        share(post - F.col("pre_baseline"), F.abs("pre_baseline"), empty=0.0).alias("shift_pct"),
    )


def rank_events(events: DataFrame, by=None) -> DataFrame:
    """Change events, strongest first, ranked within their series."""
    by = _keys(by)
    order = Window.partitionBy(*[col(b) for b in by]).orderBy(F.desc(F.abs("peak_z")), "start")
    return events.withColumn("event_rank", F.row_number().over(order)).orderBy(*by, "event_rank")


def iqr_bounds(series: DataFrame, window: int = 14, by=None) -> DataFrame:
    """Rolling quartile fences and median baseline.

    A rolling spread of zero is replaced by the series' mean spread.  Series
    shorter than the window give no rows.
    """
    by = _keys(by)
    frame = _in_order(by).rowsBetween(-(window - 1), 0)
    enough = F.count("value").over(frame) >= window // 2
    rolled = (
        series.withColumn(
            "quartiles", F.when(enough, F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(frame))
        )
        .withColumn("spread", F.col("quartiles")[2] - F.col("quartiles")[0])
        .withColumn("periods", F.count("*").over(_whole(by)))
        .withColumn("mean_spread", F.avg("spread").over(_whole(by)))
        .where(F.col("periods") >= window)
    )
    fallback = F.when(F.col("mean_spread") > 0, F.col("mean_spread")).otherwise(F.lit(1e-5))
    # fixed value: fences lie 2 spreads outside the quartiles
    spread = F.when(F.col("spread") == 0, fallback).otherwise(F.col("spread"))
    return rolled.withColumn("spread", spread).select(
        *by,
        "period",
        "value",
        F.col("quartiles")[1].alias("baseline"),
        (F.col("quartiles")[0] - 2 * F.col("spread")).alias("lower_bound"),
        (F.col("quartiles")[2] + 2 * F.col("spread")).alias("upper_bound"),
    )


def series_anomalies(series: DataFrame, window: int = 14, by=None) -> DataFrame:
    """Periods outside the rolling fences with direction, deviation, severity and its label."""
    by = _keys(by)
    bounds = iqr_bounds(series, window, by)
    up, down = F.col("value") > F.col("upper_bound"), F.col("value") < F.col("lower_bound")
    found = bounds.where(up | down).withColumn(
        "deviation",
        F.when(up, F.col("value") - F.col("upper_bound")).otherwise(F.col("lower_bound") - F.col("value")),
    )
    # fixed values: the unit is a quarter of the fence width, 30 points each, kept within 1..100
    unit = (F.col("upper_bound") - F.col("lower_bound")) / 4
    points = clamp(F.try_divide(F.col("deviation"), unit) * 30, 1, 100)
    severity = F.when(unit > 0, points).otherwise(F.lit(100.0)).cast("int")
    return (
        found.select(
            *by,
            "period",
            F.when(up, "Spike").otherwise("Drop").alias("direction"),
            F.col("value").alias("actual"),
            F.col("baseline").alias("expected"),
            "lower_bound",
            "upper_bound",
            "deviation",
            severity.alias("severity"),
        )
        .withColumn("level", severity_label(F.col("severity")))
        .orderBy(F.desc("severity"), *by, "period")
    )


CYCLES = ("Weekly", "Monthly", "Quarterly")


def _cycle_position(cycle: str) -> tuple[Column, Column]:
    stamp = F.col("stamp")
    if cycle == "Weekly":
        return F.weekday(stamp), F.date_format(stamp, "EEEE")
    if cycle == "Monthly":
        return F.month(stamp), F.date_format(stamp, "MMMM")
    if cycle == "Quarterly":
        return F.quarter(stamp), F.concat(F.lit("Q"), F.quarter(stamp).cast("string"))
    raise ValueError(f"cycle must be one of {CYCLES}")


def _calendar_sums(df: DataFrame, date_column: str, value_column: str, by: list[str]) -> DataFrame:
    """Rows collapsed to days, from which every cycle is derived."""
    rows = coerce_datetime(df, date_column, value_column, by)
    return rows.groupBy(*[col(b) for b in by], F.to_date("stamp").alias("stamp")).agg(
        F.sum("value").alias("total"), F.count("*").alias("n")
    )


def _bucket_means(days: DataFrame, cycle: str, by: list[str]) -> DataFrame:
    position, label = _cycle_position(cycle)
    return days.groupBy(*[col(b) for b in by], position.alias("position"), label.alias("bucket")).agg(
        (F.sum("total") / F.sum("n")).alias("mean_value"), F.sum("n").alias("n")
    )


def seasonality(df: DataFrame, date_column: str, value_column: str, cycle: str, by=None) -> DataFrame:
    """Mean of the raw values per weekday (Monday = 0), month or quarter."""
    by = _keys(by)
    return _bucket_means(_calendar_sums(df, date_column, value_column, by), cycle, by).orderBy(*by, "position")


def seasonality_weekly(df, date_column, value_column, by=None) -> DataFrame:
    return seasonality(df, date_column, value_column, "Weekly", by)


def seasonality_monthly(df, date_column, value_column, by=None) -> DataFrame:
    return seasonality(df, date_column, value_column, "Monthly", by)


def seasonality_quarterly(df, date_column, value_column, by=None) -> DataFrame:
    return seasonality(df, date_column, value_column, "Quarterly", by)


def _all_cycles(df: DataFrame, date_column: str, value_column: str, by: list[str]) -> DataFrame:
    """Bucket means of all three cycles from one pass over the rows."""
    days = _calendar_sums(df, date_column, value_column, by)
    positions = F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("cycle"), _cycle_position(c)[0].alias("position"), _cycle_position(c)[1].alias("bucket"))
                for c in CYCLES
            ]
        )
    )
    return (
        days.select(*[col(b) for b in by], "total", "n", positions)
        .groupBy(*[col(b) for b in by], "cycle", "position", "bucket")
        .agg((F.sum("total") / F.sum("n")).alias("mean_value"))
    )


def seasonality_strength(df: DataFrame, date_column: str, value_column: str, by=None) -> DataFrame:
    """Variation of each cycle's bucket means, its 0-100 score, and whether it is the strongest."""
    by = _keys(by)
    variation = F.when(F.avg("mean_value") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.stddev_samp("mean_value"), F.avg("mean_value"))
    )
    cycles = (
        _all_cycles(df, date_column, value_column, by)
        .groupBy(*[col(b) for b in by], "cycle")
        .agg(variation.alias("variation"))
        .where("variation IS NOT NULL")
    )
    order = F.array_position(F.array(*[F.lit(c) for c in CYCLES]), F.col("cycle"))
    best = Window.partitionBy(*[col(b) for b in by]).orderBy(F.desc("variation"), order)
    # fixed value: a variation of 0.5 scores 100
    return cycles.select(
        *by,
        "cycle",
        "variation",
        F.least(F.lit(100.0), F.col("variation") / 0.5 * 100).cast("int").alias("score"),
        (F.row_number().over(best) == 1).alias("strongest"),
    )


def seasonal_extremes(df: DataFrame, date_column: str, value_column: str, by=None) -> DataFrame:
    """Peak and low weekday and month where they differ notably; else one "None" row per series."""
    by = _keys(by)
    keys = [col(b) for b in by]
    ends = (
        _all_cycles(df, date_column, value_column, by)
        .where(F.col("cycle") != "Quarterly")
        .groupBy(*keys, "cycle")
        .agg(
            F.count("*").alias("buckets"),
            F.min_by("bucket", F.struct(-F.col("mean_value"), F.col("position"))).alias("peak"),
            F.min_by("bucket", F.struct("mean_value", "position")).alias("low"),
            F.max("mean_value").alias("peak_value"),
            F.min("mean_value").alias("low_value"),
        )
    )
    # fixed values: 10 % apart for weekdays (2 or more), 15 % for months (3 or more)
    notable = F.when(
        F.col("cycle") == "Weekly", (F.col("buckets") > 1) & (F.col("peak_value") > F.col("low_value") * 1.1)
    ).otherwise((F.col("buckets") > 2) & (F.col("peak_value") > F.col("low_value") * 1.15))
    flagged = ends.withColumn("notable", notable)
    shown = flagged.where("notable").select(*keys, "cycle", "peak", "low", "peak_value", "low_value")
    nothing = (
        flagged.groupBy(*keys)
        .agg(F.max("notable").alias("any_notable"))
        .where("NOT any_notable")
        .select(
            *keys,
            F.lit("None").alias("cycle"),
            F.lit(None).cast("string").alias("peak"),
            F.lit(None).cast("string").alias("low"),
            F.lit(None).cast("double").alias("peak_value"),
            F.lit(None).cast("double").alias("low_value"),
        )
    )
    return shown.unionByName(nothing)
