"""Time series against pandas, and calendar edges."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tablescope.operators import forecast, series

D = dt.datetime


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(3)
    days = pd.date_range("2023-01-01", periods=120)
    value = np.round(rng.normal(100, 10, 120), 2)
    value[50:53] = 400
    value[118:] = 500
    table = pd.DataFrame({"d": days, "v": value})
    return table.drop(index=[10, 11, 40])


def to_spark(spark, table):
    return spark.createDataFrame(
        [(d.to_pydatetime(), float(v)) for d, v in table.itertuples(index=False)], "d timestamp_ntz, v double"
    )


def pulled(df):
    out = df.toPandas()
    out["period"] = pd.to_datetime(out["period"])
    return out.sort_values("period").reset_index(drop=True)


@pytest.mark.parametrize("freq, pd_freq", [("D", "D"), ("W", "W"), ("M", "ME")])
def test_resample(spark, walk, freq, pd_freq):
    got = pulled(series.resample_sum(to_spark(spark, walk), "d", "v", freq))
    want = walk.set_index("d")["v"].resample(pd_freq).sum()
    assert list(got["period"]) == list(want.index)
    np.testing.assert_allclose(got["value"], want.values)


def test_sunday_and_month_end(spark):
    df = spark.createDataFrame([(D(2024, 3, 3, 23, 59), 1.0), (D(2024, 3, 4), 2.0), (D(2024, 2, 29), 4.0)], "d timestamp_ntz, v double")
    week = {r["period"]: r["value"] for r in series.resample_sum(df, "d", "v", "W").collect()}
    assert week == {dt.date(2024, 3, 3): 5.0, dt.date(2024, 3, 10): 2.0}
    month = {r["period"]: r["value"] for r in series.resample_sum(df, "d", "v", "M").collect()}
    assert month == {dt.date(2024, 2, 29): 4.0, dt.date(2024, 3, 31): 3.0}


def test_resample_by_key_keeps_own_calendar(spark):
    df = spark.createDataFrame(
        [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 4), 2.0), ("b", D(2024, 1, 2), 5.0), ("b", None, 7.0)],
        "k string, d timestamp_ntz, v double",
    )
    got = series.resample_sum(df, "d", "v", "D", "k").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a": 4, "b": 1}


def test_rolling(spark, walk):
    daily = series.resample_sum(to_spark(spark, walk), "d", "v")
    got = pulled(series.std_band(daily, 7))
    want = walk.set_index("d")["v"].resample("D").sum()
    np.testing.assert_allclose(got["moving_avg"], want.rolling(7, min_periods=1).mean())
    np.testing.assert_allclose(got["rolling_std"], want.rolling(7, min_periods=1).std().fillna(0), atol=1e-6)


def test_change_events(spark, walk):
    daily = series.resample_sum(to_spark(spark, walk), "d", "v")
    got = series.rank_events(series.change_events(daily)).toPandas()
    v = walk.set_index("d")["v"].resample("D").sum()
    mean, std = v.shift(1).rolling(14, min_periods=7).mean(), v.shift(1).rolling(14, min_periods=7).std()
    flag = (((v - mean) / std).abs() > 2.5).to_numpy()
    starts = [i for i in range(len(v)) if flag[i] and (i == 0 or not flag[i - 1])]
    assert sorted(pd.to_datetime(got["start"])) == [v.index[i] for i in starts]
    last = got[pd.to_datetime(got["start"]) == v.index[starts[-1]]].iloc[0]
    run = v.to_numpy()[starts[-1] :]
    assert last["post_baseline"] == pytest.approx(run.mean())  # reaches the end: its own level
    first = got[pd.to_datetime(got["start"]) == v.index[starts[0]]].iloc[0]
    assert first["pre_baseline"] == pytest.approx(v.to_numpy()[max(0, starts[0] - 14) : starts[0]].mean())


def test_short_series_give_nothing(spark):
    df = spark.createDataFrame([(D(2024, 1, i), 1.0) for i in range(1, 11)], "d timestamp_ntz, v double")
    daily = series.resample_sum(df, "d", "v")
    assert series.change_events(daily, 14).count() == 0
    assert series.iqr_bounds(daily, 14).count() == 0


def test_iqr_bounds(spark, walk):
    daily = series.resample_sum(to_spark(spark, walk), "d", "v")
    got = pulled(series.iqr_bounds(daily))
    v = walk.set_index("d")["v"].resample("D").sum()
    roll = v.rolling(14, min_periods=7)
    q1, q3 = roll.quantile(0.25), roll.quantile(0.75)
    np.testing.assert_allclose(got["baseline"], roll.median())
    np.testing.assert_allclose(got["upper_bound"], q3 + 2 * (q3 - q1))
    found = series.series_anomalies(daily).toPandas()
    assert found["severity"].between(1, 100).all() and found["severity"].is_monotonic_decreasing


def test_constant_series(spark):
    df = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(i), 5.0) for i in range(40)], "d timestamp_ntz, v double")
    daily = series.resample_sum(df, "d", "v")
    assert series.change_events(daily).count() == 0
    assert series.series_anomalies(daily).count() == 0
    assert series.trend_direction(daily).first()["direction"] == "Stable"
    assert series.growth(daily).first()["growth_pct"] == 0


def test_one_period(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 5.0)], "d timestamp_ntz, v double")
    daily = series.resample_sum(df, "d", "v")
    assert series.trend_direction(daily).first()["direction"] == "Stable"
    assert series.series_kpis(daily).first()["periods"] == 1


def test_seasonal_extremes(spark):
    rows = [(D(2024, 1, 1) + dt.timedelta(i), 10.0 if i % 7 == 0 else 1.0) for i in range(28)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, v double")
    got = series.seasonal_extremes(df, "d", "v").collect()
    assert [(r["cycle"], r["peak"], r["low"]) for r in got] == [("Weekly", "Monday", "Tuesday")]
    flat = spark.createDataFrame([(d, 1.0) for d, _ in rows], "d timestamp_ntz, v double")
    assert [r["cycle"] for r in series.seasonal_extremes(flat, "d", "v").collect()] == ["None"]


def ridge(period, value):
    first = period.min()
    x = np.column_stack([(period - first).days, period.dayofweek, period.month, period.quarter]).astype(float)
    xc, yc = x - x.mean(0), value - value.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc)
    intercept = value.mean() - x.mean(0) @ beta
    return beta, intercept, np.std(value - x @ beta - intercept)


@pytest.mark.parametrize("freq, pd_freq", [("D", "D"), ("W", "W"), ("M", "ME")])
def test_ridge_equals_closed_form(spark, freq, pd_freq):
    rng = np.random.default_rng(5)
    days = pd.date_range("2020-01-01", periods=500)
    table = pd.DataFrame({"d": days, "v": rng.normal(10, 1, 500) + np.arange(500) * 0.05})
    daily = series.resample_sum(to_spark(spark, table), "d", "v", freq)
    fit = forecast.ridge_forecast_fit(daily)
    got = fit.first()
    want = table.set_index("d")["v"].resample(pd_freq).sum()
    beta, intercept, spread = ridge(want.index, want.to_numpy())
    np.testing.assert_allclose(got["coefficients"], beta, rtol=1e-6, atol=1e-8)
    assert got["intercept"] == pytest.approx(intercept, rel=1e-8)
    assert got["residual_std"] == pytest.approx(spread, rel=1e-8)
    ahead = pulled(forecast.forecast(fit, 6, freq))
    dates = pd.date_range(want.index[-1], periods=7, freq=pd_freq)[1:]
    assert list(ahead["period"]) == list(dates)
    x = np.column_stack([(dates - want.index[0]).days, dates.dayofweek, dates.month, dates.quarter])
    np.testing.assert_allclose(ahead["prediction"], np.maximum(x @ beta + intercept, 0), rtol=1e-8)
    assert (ahead["upper_bound"] - ahead["prediction"]).is_monotonic_increasing
    again = pulled(forecast.forecast(fit, 6, freq, parity=True))
    assert again["prediction"].iloc[0] == pytest.approx(max(0, x[0, 1:] @ beta[1:] + intercept), rel=1e-8)


def test_forecast_needs_five_periods(spark):
    df = spark.createDataFrame([(D(2024, 1, i), 1.0) for i in range(1, 5)], "d timestamp_ntz, v double")
    assert forecast.ridge_forecast_fit(series.resample_sum(df, "d", "v")).count() == 0
