"""Pair measures with gaps, constants, ties and hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import relations


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=n)
    frame = pd.DataFrame({"x": x, "y": x * 2 + rng.normal(size=n) * 0.1, "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 9, n))})
    frame["gaps"] = np.where(rng.random(n) < 0.3, np.nan, -x)
    frame["flat"] = 1.0
    return frame


@pytest.fixture(scope="module")
def df(spark, table):
    return spark.createDataFrame(table)


def named(rows, value):
    return {(r["var1"], r["var2"]): r[value] for r in rows}


@pytest.mark.parametrize("method, op", [("pearson", relations.pearson_pairs), ("spearman", relations.spearman_pairs)])
def test_against_pandas(df, table, method, op):
    got = named(op(df).collect(), method)
    for (a, b), r in got.items():
        both = table[[a, b]].dropna()
        if "flat" in (a, b):
            assert r is None
        elif method == "pearson":
            assert r == pytest.approx(both[a].corr(both[b]), abs=1e-10)
        else:
            assert r == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-10)


def test_too_few_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 4, "a double, b double")
    assert relations.pearson_pairs(df).first()["pearson"] is None
    assert relations.spearman_pairs(df).first()["spearman"] is None
    assert relations.mutual_information(df).first()["mutual_info"] == 0.0
    with pytest.raises(ValueError):
        relations.pearson_pairs(df, ["a"])
    with pytest.raises(ValueError):
        relations.pearson_pairs(df, ["a", "a"])


def binned(s):
    return s.astype(str) if s.nunique() <= 10 else pd.cut(s, bins=10, labels=False).astype(str)


def test_mutual_information(df, table):
    got = named(relations.mutual_information(df).collect(), "mutual_info")
    for (a, b), value in got.items():
        both = table[[a, b]].dropna()
        p = pd.crosstab(binned(both[a]), binned(both[b])).to_numpy() / len(both)
        with np.errstate(divide="ignore", invalid="ignore"):
            want = np.nansum(p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))))
        assert value == pytest.approx(want, abs=1e-9)


def test_reads_of_mutual_information(spark, tmp_path):
    """Facts, small cardinalities and the pair count: three scans of a table without gaps."""
    spark.range(500).selectExpr("id % 7 AS a", "id * 1.0D AS b", "cast(id % 3 AS string) AS c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("mi", "mi")
    found = relations.mutual_information(df)
    plans = found._jdf.queryExecution().executedPlan().toString()
    jobs = len(tracker.getJobIdsForGroup("mi"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plans.split("Initial Plan")[-1].count("Scan parquet") == 1 and jobs <= 6  # two facts, each one or two stages


def test_bins_match_cut(spark):
    rng = np.random.default_rng(0)
    s = pd.Series(rng.normal(size=2000))
    got = relations.bin_for_mi(spark.createDataFrame(pd.DataFrame({"s": s}))).toPandas()["s"]
    assert list(got) == list(pd.cut(s, bins=10, labels=False).astype(str))


def test_classes_edges_and_degrees(df):
    mined = relations.mine_relationships(df)
    kinds = {(r["var1"], r["var2"]): r["relation"] for r in relations.classify_relationships(mined).collect()}
    assert kinds[("x", "y")] == "positive" and kinds[("x", "gaps")] == "negative"
    counts = relations.relationship_counts(mined).first()
    assert (counts["scanned"], counts["positive"], counts["negative"]) == (10, 1, 2)
    degrees = {r["node"]: r["degree"] for r in relations.node_degree(relations.correlation_edges(mined), df.columns).collect()}
    assert degrees == {"x": 2, "y": 2, "gaps": 2, "hot": 0, "flat": 0}


def test_nonlinear(spark):
    df = spark.range(-500, 501).select(F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("y"))
    assert relations.classify_relationships(relations.mine_relationships(df)).first()["relation"] == "nonlinear"


def test_line(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 1.0)], "x double, y double")
    got = relations.ols_pair(df, "x", "y").first()
    assert (got["pairs"], got["slope"], got["intercept"], got["y_at_max"]) == (3, 2.0, 1.0, 7.0)
    assert relations.ols_pair(df.limit(2), "x", "y").count() == 0
