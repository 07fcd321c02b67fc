from tablescope.operators import forecast, series
from catalogue.registry import query, rounded


def daily_sql(table="orders", date="o_orderdate", value="o_totalprice", freq="D", by=None):
    """A zero-filled calendar per series, built with a calendar join."""
    start = {"D": "CAST({d} AS DATE)", "W": "CAST(date_trunc('week', {d}) AS DATE)", "M": "CAST(date_trunc('month', {d}) AS DATE)"}[freq].format(d=date)
    step = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH"}[freq]
    label = {"D": "CAST(p AS DATE)", "W": "CAST(p + INTERVAL 6 DAY AS DATE)", "M": "last_day(p)"}[freq]
    k = f"{by}," if by else ""
    on = "c.p = s.p" + (f" AND c.{by} = s.{by}" if by else "")
    ck = f"c.{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(WITH s AS (SELECT {k} {start} AS p, sum({value}) AS v FROM {table} GROUP BY ALL),
      c AS (SELECT {k} unnest(generate_series(CAST(min(p) AS TIMESTAMP), CAST(max(p) AS TIMESTAMP), {step})) AS p FROM s {group})
      SELECT {ck} {label.replace('(p)', '(CAST(c.p AS DATE))').replace('(p ', '(c.p ')} AS period, coalesce(s.v, 0.0) AS value
      FROM c LEFT JOIN s ON {on})"""


DAILY = daily_sql()
MONTHLY = daily_sql(freq="M")
BY_PRIORITY = daily_sql(by="o_orderpriority")
BY_SUPPLIER = daily_sql("lineitem", "l_shipdate", "l_extendedprice", "M", "l_suppkey")


def daily(t, freq="D", by=None):
    return series.resample_sum(t("orders"), "o_orderdate", "o_totalprice", freq, by)


@query(
    "coerce_datetime_orders",
    """SELECT o_orderdate AS stamp, o_totalprice AS value FROM orders
    WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL""",
)
def _(t):
    text = t("orders").selectExpr("CAST(o_orderdate AS STRING) AS placed", "o_totalprice")
    return series.coerce_datetime(text, "placed", "o_totalprice")


for _freq, _name in (("D", "daily"), ("W", "weekly"), ("M", "monthly")):
    query(f"resample_{_name}_orders", f"SELECT period, round(value, 2) AS value FROM {daily_sql(freq=_freq)}")(
        lambda t, f=_freq: rounded(daily(t, f), 2)
    )


@query("resample_by_supplier_lineitem", f"SELECT l_suppkey, period, round(value, 2) AS value FROM {BY_SUPPLIER}")
def _(t):
    return rounded(series.resample_sum(t("lineitem"), "l_shipdate", "l_extendedprice", "M", "l_suppkey"), 2)


def frame_sql(window, by=None, back=None):
    part = f"PARTITION BY {by} " if by else ""
    return f"({part}ORDER BY period ROWS BETWEEN {back or f'{window - 1} PRECEDING'} AND CURRENT ROW)"


@query(
    "moving_average_orders",
    f"SELECT period, round(value, 2) AS value, round(avg(value) OVER {frame_sql(7)}, 4) AS moving_avg FROM {DAILY}",
)
def _(t):
    return rounded(rounded(series.moving_average(daily(t)), 4), 2, ["value"])


@query(
    "rolling_std_orders",
    f"SELECT period, round(value, 2) AS value, round(coalesce(stddev_samp(value) OVER {frame_sql(7)}, 0), 4) AS rolling_std FROM {DAILY}",
)
def _(t):
    return rounded(rounded(series.rolling_std(daily(t)), 4), 2, ["value"])


@query(
    "std_band_by_priority_orders",
    f"""SELECT o_orderpriority, period, round(ma + sd, 4) AS band_upper, round(ma - sd, 4) AS band_lower FROM
    (SELECT *, avg(value) OVER {frame_sql(7, 'o_orderpriority')} AS ma,
      coalesce(stddev_samp(value) OVER {frame_sql(7, 'o_orderpriority')}, 0) AS sd FROM {BY_PRIORITY})""",
)
def _(t):
    band = series.std_band(daily(t, by="o_orderpriority"), by="o_orderpriority")
    return rounded(band.select("o_orderpriority", "period", "band_upper", "band_lower"), 4)


def trend_sql(source, by=None):
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {k}periods, round(slope, 6) AS slope, round(slope / level, 6) AS relative_slope,
      CASE WHEN slope / level > 0.01 THEN 'Increasing' WHEN slope / level < -0.01 THEN 'Decreasing' ELSE 'Stable' END AS direction
    FROM (SELECT {k}count(*) AS periods, regr_slope(ma, rn) AS slope, CASE WHEN avg(ma) = 0 THEN 1 ELSE avg(ma) END AS level
      FROM (SELECT *, avg(value) OVER {frame_sql(7, by)} AS ma, row_number() OVER ({part}ORDER BY period) AS rn FROM {source}) GROUP BY ALL)"""


@query("trend_direction_orders", trend_sql(DAILY))
def _(t):
    return rounded(series.trend_direction(daily(t)))


@query("trend_direction_by_supplier_lineitem", trend_sql(BY_SUPPLIER, "l_suppkey"))
def _(t):
    ships = series.resample_sum(t("lineitem"), "l_shipdate", "l_extendedprice", "M", "l_suppkey")
    return rounded(series.trend_direction(ships, by="l_suppkey"))


@query(
    "growth_by_priority_orders",
    f"""SELECT o_orderpriority, round(s, 4) AS start_value, round(e, 4) AS end_value, round((e - s) / abs(s) * 100, 6) AS growth_pct
    FROM (SELECT o_orderpriority, avg(CASE WHEN rn <= 7 THEN ma END) AS s, avg(CASE WHEN rn > n - 7 THEN ma END) AS e FROM
      (SELECT *, avg(value) OVER {frame_sql(7, 'o_orderpriority')} AS ma,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) AS rn,
        count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {BY_PRIORITY}) GROUP BY 1)""",
)
def _(t):
    out = series.growth(daily(t, by="o_orderpriority"), by="o_orderpriority")
    return rounded(rounded(out), 4, ["start_value", "end_value"])


@query(
    "series_kpis_orders",
    f"""SELECT round(max(value), 2) AS peak_value, (SELECT period FROM {DAILY} ORDER BY value DESC, period LIMIT 1) AS peak_period,
      round(sum(value), 2) AS total, count(*) AS periods FROM {DAILY}""",
)
def _(t):
    return rounded(series.series_kpis(daily(t)), 2)


def zscore_sql(source, by=None, window=14):
    part = f"PARTITION BY {by} " if by else ""
    frame = f"({part}ORDER BY period ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return f"""(SELECT *, coalesce(abs(z) > 2.5, false) AS chg FROM (SELECT *,
      CASE WHEN count(value) OVER {frame} >= {window // 2} THEN (value - avg(value) OVER {frame}) /
        CASE WHEN stddev_samp(value) OVER {frame} = 0 THEN 1e-5 ELSE stddev_samp(value) OVER {frame} END END AS z,
      row_number() OVER ({part}ORDER BY period) AS rn, count(*) OVER ({part}) AS n FROM {source}) WHERE n >= {2 * window})"""


@query(
    "change_zscore_orders",
    f"SELECT period, round(value, 2) AS value, round(z, 4) AS z_score, chg AS is_change FROM {zscore_sql(DAILY)}",
)
def _(t):
    return rounded(rounded(series.change_zscore(daily(t)), 4), 2, ["value"])


def events_sql(source, by=None, window=14):
    k = f"{by}, " if by else ""
    same = f"AND s.{by} = e.{by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""(WITH s AS (SELECT * FROM {zscore_sql(source, by, window)}),
      g AS (SELECT *, rn - row_number() OVER ({part}ORDER BY rn) AS grp FROM s WHERE chg),
      e AS (SELECT {k}grp, min(rn) AS r0, max(rn) AS r1, min(period) AS start, count(*) AS length,
        arg_min(z, rn) AS z0, arg_max(z, abs(z)) AS pz, avg(value) AS own FROM g GROUP BY ALL),
      b AS (SELECT {", ".join(f"e.{c}" for c in ([by] if by else []) + ["grp"])}, any_value(start) AS start, any_value(length) AS length,
        any_value(z0) AS z0, any_value(pz) AS pz,
        coalesce(avg(CASE WHEN s.rn >= r0 - {window} AND s.rn < r0 THEN s.value END), any_value(CASE WHEN s.rn = r0 THEN s.value END)) AS pre,
        coalesce(avg(CASE WHEN s.rn > r1 AND s.rn <= r1 + {window} THEN s.value END), any_value(own)) AS post
        FROM e JOIN s ON s.rn >= r0 - {window} AND s.rn <= r1 + {window} {same} GROUP BY ALL)
      SELECT {k}start, length, CASE WHEN z0 > 0 THEN 'Spike' ELSE 'Drop' END AS direction, pz AS peak_z, pre AS pre_baseline,
        post AS post_baseline, CASE WHEN pre = 0 THEN 0.0 ELSE (post - pre) / abs(pre) * 100 END AS shift_pct FROM b)"""


EVENT_COLUMNS = """start, length, direction, round(peak_z, 4) AS peak_z, round(pre_baseline, 4) AS pre_baseline,
  round(post_baseline, 4) AS post_baseline, round(shift_pct, 4) AS shift_pct"""


@query("change_events_orders", f"SELECT {EVENT_COLUMNS} FROM {events_sql(DAILY)}")
def _(t):
    return rounded(series.change_events(daily(t)), 4)


@query(
    "ranked_events_by_priority_orders",
    f"""SELECT o_orderpriority, {EVENT_COLUMNS}, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY abs(peak_z) DESC, start) AS INTEGER) AS event_rank
    FROM {events_sql(BY_PRIORITY, 'o_orderpriority')}""",
)
def _(t):
    events = series.change_events(daily(t, by="o_orderpriority"), by="o_orderpriority")
    return rounded(series.rank_events(events, "o_orderpriority"), 4)


def bounds_sql(source, window=14):
    f = frame_sql(window)
    return f"""(SELECT period, value, q2 AS baseline, q1 - 2 * w AS lower_bound, q3 + 2 * w AS upper_bound FROM
      (SELECT *, CASE WHEN q3 - q1 = 0 THEN CASE WHEN m > 0 THEN m ELSE 1e-5 END ELSE q3 - q1 END AS w FROM
        (SELECT *, avg(q3 - q1) OVER () AS m, count(*) OVER () AS n FROM (SELECT period, value,
          CASE WHEN count(*) OVER {f} >= {window // 2} THEN quantile_cont(value, 0.25) OVER {f} END AS q1,
          CASE WHEN count(*) OVER {f} >= {window // 2} THEN quantile_cont(value, 0.5) OVER {f} END AS q2,
          CASE WHEN count(*) OVER {f} >= {window // 2} THEN quantile_cont(value, 0.75) OVER {f} END AS q3
        FROM {source})) WHERE n >= {window}))"""


@query(
    "iqr_bounds_orders",
    f"""SELECT period, round(value, 2) AS value, round(baseline, 4) AS baseline, round(lower_bound, 4) AS lower_bound,
      round(upper_bound, 4) AS upper_bound FROM {bounds_sql(DAILY)}""",
)
def _(t):
    return rounded(rounded(series.iqr_bounds(daily(t)), 4), 2, ["value"])


@query(
    "series_anomalies_orders",
    f"""SELECT *, CASE WHEN severity > 80 THEN 'CRITICAL' WHEN severity > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM
    (SELECT period, CASE WHEN value > upper_bound THEN 'Spike' ELSE 'Drop' END AS direction, round(value, 2) AS actual,
      round(baseline, 4) AS expected, round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound,
      round(greatest(value - upper_bound, lower_bound - value), 4) AS deviation,
      CAST(trunc(least(100, greatest(1, greatest(value - upper_bound, lower_bound - value) / ((upper_bound - lower_bound) / 4) * 30))) AS INTEGER) AS severity
    FROM {bounds_sql(DAILY)} WHERE value > upper_bound OR value < lower_bound)""",
)
def _(t):
    return rounded(rounded(series.series_anomalies(daily(t)), 4), 2, ["actual"])


CYCLE_SQL = {
    "Weekly": "(dayofweek(o_orderdate) + 6) % 7",
    "Monthly": "month(o_orderdate)",
    "Quarterly": "quarter(o_orderdate)",
}
LABEL_SQL = {
    "Weekly": "dayname(o_orderdate)",
    "Monthly": "monthname(o_orderdate)",
    "Quarterly": "'Q' || quarter(o_orderdate)",
}


def cycle_sql(cycle):
    return f"""SELECT CAST({CYCLE_SQL[cycle]} AS INTEGER) AS position, {LABEL_SQL[cycle]} AS bucket,
      avg(o_totalprice) AS mean_value, count(*) AS n FROM orders GROUP BY 1, 2"""


for _cycle in CYCLE_SQL:
    query(
        f"seasonality_{_cycle.lower()}_orders",
        f"SELECT position, bucket, round(mean_value, 6) AS mean_value, n FROM ({cycle_sql(_cycle)})",
    )(lambda t, c=_cycle: rounded(series.seasonality(t("orders"), "o_orderdate", "o_totalprice", c), 6))


@query(
    "seasonality_strength_orders",
    f"""SELECT cycle, round(v, 8) AS variation, CAST(trunc(least(100, v / 0.5 * 100)) AS INTEGER) AS score,
      row_number() OVER (ORDER BY v DESC, cycle) = 1 AS strongest FROM ({" UNION ALL ".join(
          f"SELECT '{c}' AS cycle, stddev_samp(mean_value) / avg(mean_value) AS v FROM ({cycle_sql(c)})" for c in CYCLE_SQL)})""",
)
def _(t):
    return rounded(series.seasonality_strength(t("orders"), "o_orderdate", "o_totalprice"), 8)


PURCHASE_CYCLES = """SELECT user_id, 'Weekly' AS cycle, (dayofweek(ts) + 6) % 7 AS position, dayname(ts) AS bucket, avg(value) AS m
    FROM events GROUP BY ALL UNION ALL
  SELECT user_id, 'Monthly', month(ts), monthname(ts), avg(value) FROM events GROUP BY ALL"""


@query(
    "seasonal_extremes_by_user_events",
    f"""WITH e AS (SELECT user_id, cycle, count(*) AS k, arg_min(bucket, row(-m, position)) AS peak, arg_min(bucket, row(m, position)) AS low,
        max(m) AS hi, min(m) AS lo FROM ({PURCHASE_CYCLES}) GROUP BY ALL),
      f AS (SELECT *, CASE cycle WHEN 'Weekly' THEN k > 1 AND hi > lo * 1.1 ELSE k > 2 AND hi > lo * 1.15 END AS ok FROM e)
    SELECT user_id, cycle, peak, low, round(hi, 6) AS peak_value, round(lo, 6) AS low_value FROM f WHERE ok UNION ALL
    SELECT user_id, 'None', NULL, NULL, NULL, NULL FROM f GROUP BY user_id HAVING NOT bool_or(ok)""",
)
def _(t):
    return rounded(series.seasonal_extremes(t("events"), "ts", "value", "user_id"), 6)


FEATURE_SQL = "CAST(period - f AS DOUBLE) AS x0, CAST((dayofweek(period) + 6) % 7 AS DOUBLE) AS x1, CAST(month(period) AS DOUBLE) AS x2, CAST(quarter(period) AS DOUBLE) AS x3"


@query(
    "calendar_features_by_priority_orders",
    f"""SELECT o_orderpriority, period, round(value, 2) AS value, x0 AS days_since, x1 AS day_of_week, x2 AS month, x3 AS quarter FROM
    (SELECT o_orderpriority, period, value, {FEATURE_SQL} FROM (SELECT *, min(period) OVER (PARTITION BY o_orderpriority) AS f FROM {BY_PRIORITY}))""",
)
def _(t):
    return rounded(forecast.with_calendar_features(daily(t, by="o_orderpriority"), "o_orderpriority"), 2)


def ridge_sql(source, by="o_orderpriority"):
    """CTEs ending in ``fit``: Gauss-Jordan on the penalised normal equations, one row per series."""
    r = range(4)
    gram = [f"covar_pop(x{i}, x{j}) * count(*) + {1 if i == j else 0} AS m{i}{j}" for i in r for j in r]
    rhs = [f"covar_pop(x{i}, value) * count(*) AS m{i}4" for i in r]
    keep = "k, n, f, l, my, mny, " + ", ".join(f"a{i}" for i in r)
    steps = [
        f"""x AS (SELECT {by} AS k, period, value, f, {FEATURE_SQL} FROM (SELECT *, min(period) OVER (PARTITION BY {by}) AS f FROM {source})),
      g0 AS (SELECT k, count(*) AS n, min(period) AS f, max(period) AS l, avg(value) AS my, min(value) AS mny,
        {", ".join(f"avg(x{i}) AS a{i}" for i in r)}, {", ".join(gram + rhs)} FROM x GROUP BY k)"""
    ]
    for p in r:
        cells = [f"m{i}{j} - m{i}{p} / m{p}{p} * m{p}{j} AS m{i}{j}" if i != p else f"m{i}{j}" for i in r for j in range(5)]
        steps.append(f"g{p + 1} AS (SELECT {keep}, {', '.join(cells)} FROM g{p})")
    betas = ", ".join(f"m{i}4 / m{i}{i} AS b{i}" for i in r)
    steps.append(f"b AS (SELECT {keep}, {betas} FROM g4)")
    steps.append(f"c AS (SELECT *, my - ({' + '.join(f'b{i} * a{i}' for i in r)}) AS icpt FROM b)")
    steps.append(
        f"""fit AS (SELECT c.*, sd FROM c JOIN (SELECT x.k, stddev_pop(value - icpt - ({' + '.join(f'b{i} * x{i}' for i in r)})) AS sd
        FROM x JOIN c ON x.k = c.k GROUP BY x.k) s ON s.k = c.k)"""
    )
    return ",\n".join(steps)


@query(
    "ridge_forecast_fit_orders",
    f"""WITH {ridge_sql(BY_PRIORITY)} SELECT k AS o_orderpriority, n AS periods, f AS first_period, l AS last_period,
      round(b0, 4) AS c0, round(b1, 4) AS c1, round(b2, 4) AS c2, round(b3, 4) AS c3, round(icpt, 3) AS intercept,
      round(sd, 3) AS residual_std FROM fit""",
)
def _(t):
    fit = forecast.ridge_forecast_fit(daily(t, by="o_orderpriority"), "o_orderpriority")
    wide = fit.selectExpr(
        "o_orderpriority", "periods", "first_period", "last_period",
        *[f"round(coefficients[{i}], 4) AS c{i}" for i in range(4)],
        "round(intercept, 3) AS intercept", "round(residual_std, 3) AS residual_std",
    )
    return wide


FUTURE = f"""fut AS (SELECT k AS o_orderpriority, step, period, my, mny, sd, icpt + b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3 AS raw FROM
    (SELECT *, {FEATURE_SQL} FROM (SELECT fit.*, CAST(step AS INTEGER) AS step, CAST(l + CAST(step AS INTEGER) AS DATE) AS period
      FROM fit, (SELECT unnest(range(1, 31)) AS step)))),
  pred AS (SELECT o_orderpriority, step, period, my, CASE WHEN mny >= 0 THEN greatest(raw, 0) ELSE raw END AS prediction,
    CASE WHEN mny >= 0 THEN greatest(raw - 1.96 * sd * sqrt(step), 0) ELSE raw - 1.96 * sd * sqrt(step) END AS lower_bound,
    CASE WHEN mny >= 0 THEN greatest(raw + 1.96 * sd * sqrt(step), 0) ELSE raw + 1.96 * sd * sqrt(step) END AS upper_bound FROM fut)"""


@query(
    "forecast_by_priority_orders",
    f"""WITH {ridge_sql(BY_PRIORITY)}, {FUTURE} SELECT o_orderpriority, step, period, round(prediction, 3) AS prediction,
      round(lower_bound, 3) AS lower_bound, round(upper_bound, 3) AS upper_bound FROM pred""",
)
def _(t):
    fit = forecast.ridge_forecast_fit(daily(t, by="o_orderpriority"), "o_orderpriority")
    return rounded(forecast.forecast(fit, 30, "D", "o_orderpriority").drop("mean_value"), 3)


@query(
    "forecast_kpis_orders",
    f"""WITH {ridge_sql(BY_PRIORITY)}, {FUTURE} SELECT o_orderpriority, round(any_value(my), 4) AS historical_mean,
      round(arg_max(prediction, step), 4) AS projected_end, max(step) AS horizon,
      round((arg_max(prediction, step) - any_value(my)) / abs(any_value(my)) * 100, 4) AS growth_pct FROM pred GROUP BY 1""",
)
def _(t):
    fit = forecast.ridge_forecast_fit(daily(t, by="o_orderpriority"), "o_orderpriority")
    out = forecast.forecast_kpis(forecast.forecast(fit, 30, "D", "o_orderpriority"), "o_orderpriority")
    return rounded(out, 4)
