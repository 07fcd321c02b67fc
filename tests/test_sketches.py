"""Sketched quantiles: rank errors on skewed and tied columns, merging, and the operators that offer them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.operators import anomalies, describe, features, quality, sketches


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 60_000
    skewed = np.exp(rng.normal(0, 3, n))
    tied = rng.choice([0.0, 1.0, 1.0, 1.0, 2.0, 7.5], n)
    rows = [(int(i), i % 5, float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(zip(skewed, tied))]
    return spark.createDataFrame(rows, "id long, day int, skewed double, tied double").repartition(7).cache()


def rank_error(values, q, p):
    """How far p lies outside the ranks that q takes."""
    low, high = np.mean(values < q), np.mean(values <= q)
    return max(0.0, low - p, p - high)


@pytest.mark.parametrize("merged", [False, True])
def test_rank_error(table, merged, tmp_path):
    probs = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    made = sketches.quantile_sketches(table, ["skewed", "tied"], ["day"] if merged else [])
    if merged:  # stored per day, merged later
        made.write.parquet(str(tmp_path / "days"))
        made = sketches.merge_sketches(table.sparkSession.read.parquet(str(tmp_path / "days")))
    frame = table.toPandas()
    for r in sketches.quantiles_of(made, probs).collect():
        values = frame[r["column"]].dropna().to_numpy()
        assert (r["n"], r["min"], r["max"]) == (len(values), values.min(), values.max())
        for i, p in enumerate(probs):
            assert rank_error(values, r[f"q{i}"], p) <= sketches.RANK_ERROR


def test_operators(table):
    frame = table.toPandas()
    values = frame["skewed"].to_numpy()
    r = describe.describe_numeric(table, ["skewed"], approx=True).first()
    assert all(rank_error(values, r[f"p{p}"], p / 100) <= sketches.RANK_ERROR for p in (25, 50, 75)) and r["n"] == len(values)
    a = quality.iqr_audit(table, ["skewed"], approx=True).first()
    assert rank_error(values, a["q1"], 0.25) <= sketches.RANK_ERROR and a["outliers"] == np.sum((values < a["lower_bound"]) | (values > a["upper_bound"]))
    assert features.impute_median(table, ["tied"], approx=True).where("tied = 1.0").count() == (frame["tied"].isna() | (frame["tied"] == 1)).sum()
    labelled = anomalies.contamination_labels(table, "skewed", 0.05, approx=True)
    share = labelled.where(F.col("is_anomaly") == anomalies.ANOMALY).count() / len(values)
    assert abs(share - 0.05) <= sketches.RANK_ERROR
    both = anomalies.scored_labels(table, "skewed", 0.05, approx=True)
    assert abs(both.where(F.col("is_anomaly") == anomalies.ANOMALY).count() / len(values) - 0.05) <= sketches.RANK_ERROR
    assert both.agg(F.min("anomaly_score"), F.max("anomaly_score")).first() == (0.0, 1.0)


def test_nothing_to_sketch(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert sketches.quantile_sketches(df, ["x"]).collect() == []
    assert sketches.quantiles_of(sketches.merge_sketches(sketches.quantile_sketches(df, ["x"])), [0.5]).collect() == []
