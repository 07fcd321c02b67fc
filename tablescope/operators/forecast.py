"""Trend and calendar regression on resampled series.

Fitting one series or a million takes one aggregate of centred second moments;
only the 4 x 4 solve per series runs in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablescope.functions.columns import col
from tablescope.functions.dates import calendar_features
from tablescope.functions.numbers import share
from tablescope.operators.series import _keys

FEATURES = ["days_since", "day_of_week", "month", "quarter"]
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
LEAST_PERIODS = 5
EPOCH = "1970-01-01"


def with_calendar_features(series: DataFrame, by=None) -> DataFrame:
    """Add days since the first period of the series, weekday, month and quarter."""
    by = _keys(by)
    if by:
        first = series.groupBy(*[col(b) for b in by]).agg(F.min("period").alias("first_period"))
        based = series.join(first, by)
    else:
        based = series.withColumn("first_period", series.agg(F.min("period")).scalar())
    return based.select(*series.columns, *calendar_features(F.col("period"), F.col("first_period")))


FIT_TYPE = T.StructType(
    [T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("residual_std", T.DoubleType())]
)


@F.pandas_udf(FIT_TYPE)
def _solve(moments: pd.Series) -> pd.DataFrame:
    """Ridge coefficients (penalty 1, free intercept) from population moments."""
    k, p = len(FEATURES), len(PAIRS)
    rows = np.array(moments.tolist(), dtype=float).reshape(-1, 2 + k + p)
    n, yy, xy, xx = rows[:, 0], rows[:, 1], rows[:, 2 : 2 + k], rows[:, 2 + k :]
    gram = np.zeros((len(rows), k, k))
    for at, (i, j) in enumerate(PAIRS):
        gram[:, i, j] = gram[:, j, i] = xx[:, at]
    # fixed value: ridge penalty 1
    beta = np.linalg.solve(gram * n[:, None, None] + np.eye(k), (xy * n[:, None])[..., None])[..., 0]
    left = yy - 2 * (beta * xy).sum(1) + np.einsum("ni,nij,nj->n", beta, gram, beta)
    return pd.DataFrame({"coefficients": list(beta), "residual_std": np.sqrt(np.maximum(left, 0))})


def ridge_forecast_fit(series: DataFrame, by=None) -> DataFrame:
    """Per series of at least five periods: coefficients, intercept, residual deviation, history.

    Covariances ignore the origin of time, so days are counted from a fixed
    date and only the mean is shifted to the first period afterwards.
    """
    by = _keys(by)
    x = calendar_features(F.col("period"), F.lit(EPOCH).cast("date"))
    named = series.select(*[col(b) for b in by], "period", "value", *x)
    moments = named.groupBy(*[col(b) for b in by]).agg(
        F.count("*").alias("periods"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.avg("value").alias("mean_value"),
        F.min("value").alias("min_value"),
        F.array(*[F.avg(f) for f in FEATURES]).alias("means"),
        F.array(
            F.count("*").cast("double"),
            F.var_pop("value"),
            *[F.covar_pop(f, "value") for f in FEATURES],
            *[F.covar_pop(FEATURES[i], FEATURES[j]) for i, j in PAIRS],
        ).alias("moments"),
    )
    solved = moments.where(F.col("periods") >= LEAST_PERIODS).withColumn("fit", _solve("moments"))
    start = F.datediff("first_period", F.lit(EPOCH).cast("date"))
    centre = [F.col("means")[0] - start, *[F.col("means")[i] for i in range(1, len(FEATURES))]]
    beta = F.col("fit")["coefficients"]
    explained = sum((beta[i] * centre[i] for i in range(len(FEATURES))), F.lit(0.0))
    return solved.select(
        *by,
        "periods",
        "first_period",
        "last_period",
        "mean_value",
        "min_value",
        beta.alias("coefficients"),
        (F.col("mean_value") - explained).alias("intercept"),
        F.col("fit")["residual_std"].alias("residual_std"),
    )


def _future(last: Column, step: Column, freq: str) -> Column:
    if freq == "D":
        return F.date_add(last, step)
    if freq == "W":
        return F.date_add(last, step * 7)
    return F.last_day(F.add_months(last, step))


def forecast(model: DataFrame, horizon: int = 30, freq: str = "D", by=None, parity: bool = False) -> DataFrame:
    """The next ``horizon`` periods of every fitted series with a widening 95 % interval.

    Days count from the start of the history, so the trend carries on;
    ``parity=True`` restarts them at the first forecast period.  Everything is
    kept at or above 0 when the history never went below.
    """
    by = _keys(by)
    steps = model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    dated = steps.withColumn("period", _future(F.col("last_period"), F.col("step"), freq))
    origin = _future(F.col("last_period"), F.lit(1), freq) if parity else F.col("first_period")
    x = calendar_features(F.col("period"), origin)
    raw = F.col("intercept") + sum((F.col("coefficients")[i] * x[i] for i in range(len(FEATURES))), F.lit(0.0))
    # fixed value: 1.96 deviations, growing with the square root of the step
    margin = 1.96 * F.col("residual_std") * F.sqrt("step")
    floor = F.when(F.col("min_value") >= 0, F.lit(0.0))

    def kept(value: Column) -> Column:
        return F.greatest(value, floor)  # greatest skips a NULL floor

    return dated.withColumn("raw", raw).select(
        *by,
        "step",
        "period",
        kept(F.col("raw")).alias("prediction"),
        kept(F.col("raw") - margin).alias("lower_bound"),
        kept(F.col("raw") + margin).alias("upper_bound"),
        "mean_value",
    )


def forecast_kpis(predictions: DataFrame, by=None) -> DataFrame:
    """Historical mean, prediction at the horizon, and its growth over the mean."""
    by = _keys(by)
    ends = predictions.groupBy(*[col(b) for b in by]).agg(
        F.first("mean_value").alias("historical_mean"),
        F.max_by("prediction", "step").alias("projected_end"),
        F.max("step").alias("horizon"),
    )
    change = share(F.col("projected_end") - F.col("historical_mean"), F.abs("historical_mean"), empty=0.0)
    return ends.withColumn("growth_pct", change)
