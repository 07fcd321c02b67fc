"""Profiling, quality, quantiles, descriptions: missing values, ties, constants, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions.dates import parse_timestamp
from tablescope.operators import describe, order_stats, profile, quality

NAN = float("nan")


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.0, "a", True), (2, NAN, "b", None), (3, None, None, True), (1, 1.0, "a", True), (5, 100.0, "a", False)]
    return spark.createDataFrame(rows, "i int, x double, s string, b boolean")


def test_null_and_nan_are_one(small):
    got = profile.table_stats(small).first().asDict()
    assert got["missing_cells"] == 4 and got["duplicate_rows"] == 1 and got["n_rows"] == 5
    cells = {r["column"]: r for r in profile.schema_profile(small).collect()}
    assert (cells["x"]["nulls"], cells["x"]["distinct_values"]) == (2, 2)
    assert (cells["b"]["nulls"], cells["b"]["distinct_values"]) == (1, 2)


def test_nan_and_null_rows_are_duplicates(spark):
    df = spark.createDataFrame([(1, NAN), (1, None), (2, 3.0)], "i int, x double")
    assert quality.consistency(df).first()["duplicate_rows"] == 1
    assert quality.duplicate_groups(df).first()["copies"] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "i int, x double, s string")
    got = profile.table_stats(df).first()
    assert (got["n_rows"], got["missing_pct"], got["duplicate_rows"]) == (0, 0.0, 0)
    health = quality.overall_health(df).first()
    assert (health["completeness"], health["consistency"], health["outlier_health"], health["overall"]) == (100, 100, 100, 100)
    assert [r["nulls"] for r in profile.schema_profile(df).collect()] == [0, 0, 0]
    assert order_stats.exact_quantiles(df, ["x"], [0.5]).count() == 0


def test_approximate_profile_matches_on_small_data(small):
    exact = [r["distinct_values"] for r in profile.schema_profile(small).collect()]
    assert [r["distinct_values"] for r in profile.schema_profile(small, approx=True).collect()] == exact


def test_map_and_array_columns(spark):
    df = spark.sql("SELECT map('a', 1) m, array(1, 2) v UNION ALL SELECT map('a', 1), array(1, 2)")
    assert profile.table_stats(df).first()["duplicate_rows"] == 1
    assert {r["column"]: r["distinct_values"] for r in profile.schema_profile(df).collect()} == {"m": 1, "v": 1}


@pytest.mark.parametrize("rank_error", [1e-4, 2e-3])
@pytest.mark.parametrize("kind", ["normal", "ties", "skewed"])
def test_quantiles_equal_numpy(spark, rank_error, kind):
    rng = np.random.default_rng(7)
    n = 30_000
    values = {
        "normal": rng.normal(size=n),
        "ties": np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, 50, n).astype(float)),
        "skewed": np.exp(rng.normal(size=n) * 4),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = order_stats.exact_quantiles(df, ["x"], probs, rank_error).first()
    for j, p in enumerate(probs):
        assert got[f"q{j}"] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_of_few_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    got = order_stats.exact_quantiles(df, ["x", "y"], [0.25, 0.75]).collect()
    assert len(got) == 1 and (got[0]["q0"], got[0]["q1"]) == (1.25, 1.75)


def test_outliers(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 5, 100]], "x double, c double")
    rows = quality.iqr_outliers(df).collect()
    assert [(r["column"], r["outliers"], r["max_value"]) for r in rows] == [("x", 1, 100.0)]


def test_describe(small):
    got = {r["column"]: r for r in describe.describe_numeric(small).collect()}
    assert got["x"]["n"] == 3 and got["x"]["p50"] == 1.0 and got["i"]["std"] == pytest.approx(np.std([1, 2, 3, 1, 5], ddof=1))
    top = {r["column"]: r for r in describe.describe_categorical(small).collect()}
    assert (top["s"]["top"], top["s"]["freq"], top["s"]["unique_values"]) == ("a", 3, 2)


def test_metrics(small):
    assert describe.metric_average(small, "x").first()["value"] == 34.0
    assert describe.metric_count(small, "x").first()["value"] == 3
    assert describe.metric_max(small, "x").first()["value"] == 100.0
    with pytest.raises(ValueError):
        describe.metric_sum(small, "s")
    with pytest.raises(ValueError):
        describe.metric_min(small, "nowhere")


def test_low_cardinality(spark):
    df = spark.range(100).select("id", F.concat(F.lit("k"), F.col("id") % 29).alias("few"), F.concat(F.lit("k"), F.col("id") % 31).alias("many"))
    assert profile.low_cardinality_columns(df) == ["id", "few"]


def test_date_detection(spark):
    df = spark.createDataFrame([("2024-01-05", "x", "03/04/2024", "12"), (None, "y", "12/25/2023", "13")], "a string, b string, c string, year string")
    assert profile.detect_date_columns(df) == ["a", "c"]
    assert profile.primary_date_column(df) == "a"
    late = spark.range(200).select(F.when(F.col("id") < 150, "2024-01-05").otherwise("word").alias("date"))
    assert profile.detect_date_columns(late) == [] and profile.primary_date_column(late) is None
    assert profile.primary_date_column(df.select("b", "year")) is None
    assert profile.primary_date_column(df.selectExpr("b", "to_date(a) AS d")) == "d"


def test_mixed_dates(spark):
    texts = ["2024-02-03", "2024-02-03 04:05:06", "2024-02-03T04:05:06", "02/03/2024", "3 Feb 2024", "Feb 3, 2024", "junk", "17"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["d"] for r in df.select("i", F.to_date(parse_timestamp(F.col("t"))).alias("d")).orderBy("i").collect()]
    assert [d is not None for d in got] == [True] * 6 + [False] * 2
    assert len({str(d) for d in got[:6]}) == 1


def test_row_ranks_with_a_hot_value(spark, monkeypatch):
    """Values within and across buckets, a hot value, gaps and a view with more gaps."""
    import pandas as pd

    monkeypatch.setattr(order_stats, "LEAST_BUCKETS", 16)
    values = [5.0] * 400 + [float(v % 150) for v in range(200)] + [None] * 20 + [-math.inf, math.inf]
    df = spark.createDataFrame([(i, v, i % 3 == 0) for i, v in enumerate(values)], "i long, v double, odd boolean").repartition(6)
    views = {"all": ("v", F.col("v")), "some": ("v", F.when(F.col("odd"), F.col("v")))}
    got = order_stats.row_ranks(df, views, len(values)).orderBy("i").toPandas()
    frame = pd.Series(values, dtype=float)
    assert got["all"].equals(frame.rank())
    assert got["some"].equals(frame.where(frame.index % 3 == 0).rank())
    # a column of few values is looked up: no shuffle beside the one of the facts
    few = spark.range(3000).select((F.col("id") % 7).cast("double").alias("v"))
    plan = order_stats.row_ranks(few, {"r": ("v", F.col("v"))}, 3000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
