"""Segmentation: k-means, summaries of a labelling, silhouette."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from tablescope.functions.columns import col, number, numeric_columns, require_columns, require_key
from tablescope.functions.numbers import share, zero_as
from tablescope.operators.describe import column_moments
from tablescope.operators.features import sparse_vector
from tablescope.operators.silhouettes import euclidean_silhouette

NOISE = "Outliers/Noise"


def kmeans_segments(
    df: DataFrame, columns: Sequence[str], key, k: int = 4, seed: int = 42, max_iter: int = 20
) -> DataFrame:
    """``key..., segment`` from k-means on the prepared features.

    ``k`` is capped at the row count.  Segments are numbered by their smallest
    key, so the names do not depend on the order of the centres.
    """
    key = require_key(df, key)
    rows = df.limit(k).count()
    if rows < 2:
        raise ValueError("clustering needs at least 2 rows")
    vectors = sparse_vector(df, columns, key)
    model = KMeans(k=min(k, rows), seed=seed, maxIter=max_iter).fit(vectors)
    labelled = model.transform(vectors).select(*key, F.col("prediction").alias("centre"))
    first = labelled.groupBy("centre").agg(F.min(F.struct(*[col(x) for x in key])).alias("first_key"))
    order = Window.orderBy("first_key")  # one row per cluster
    names = first.select(
        "centre", F.concat(F.lit("Cluster "), (F.row_number().over(order) - 1).cast("string")).alias("segment")
    )
    return labelled.join(F.broadcast(names), "centre").select(*key, "segment")  # names: at most k rows


def segment_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share (2 dp) per label, in label order."""
    counts = df.groupBy(col(label).alias("segment")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("segment", "n", F.round(share(F.col("n"), total), 2).alias("pct")).orderBy("segment")


def segment_summary(df: DataFrame, label: str) -> DataFrame:
    """Number of segments without noise, their mean size (truncated), noise rows and share."""
    counts = df.groupBy(col(label).alias("segment")).agg(F.count("*").alias("n"))
    noise = F.col("segment").cast("string") == NOISE
    sums = counts.agg(
        F.count(F.when(~noise, 1)).alias("segments"),
        F.coalesce(F.sum(F.when(~noise, F.col("n"))), F.lit(0)).alias("clustered"),
        F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).alias("noise_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )
    return sums.select(
        "segments",
        F.coalesce(F.try_divide("clustered", "segments").cast("bigint"), F.lit(0).cast("bigint")).alias("mean_size"),
        "noise_rows",
        share(F.col("noise_rows"), F.col("n_rows"), empty=0.0).alias("noise_pct"),
    )


def largest_segment(df: DataFrame, label: str) -> DataFrame:
    """The dominant segment other than noise, its size and share of all rows."""
    counts = df.groupBy(col(label).alias("segment")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.withColumn("pct", share(F.col("n"), total))
        .where(F.col("segment").cast("string") != NOISE)
        .orderBy(F.desc("n"), "segment")
        .limit(1)
    )


def _segment_means(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """``segment, position, feature, segment_mean`` and the global mean and deviation."""
    columns = require_columns(df, columns)
    base = df.select(col(label).alias("segment"), *[number(df, c).alias(f"f{i}") for i, c in enumerate(columns)])
    means = base.groupBy("segment").agg(*[F.avg(f"f{i}").alias(f"f{i}") for i in range(len(columns))])
    rows = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"f{i}").alias("segment_mean"))
                for i, c in enumerate(columns)
            ]
        )
    )
    whole = column_moments(df, columns).select(
        F.col("column").alias("feature"), F.col("mean").alias("global_mean"), F.col("std").alias("global_std")
    )
    return means.select("segment", rows).join(F.broadcast(whole), "feature")  # whole: one row per column


def distinguishing_features(
    df: DataFrame, label: str, columns: Sequence[str] | None = None, top: int = 5
) -> DataFrame:
    """Per segment: the features whose mean lies furthest from the whole table's, in deviations."""
    columns = list(columns or [c for c in numeric_columns(df) if c != label])
    z = (F.col("segment_mean") - F.col("global_mean")) / zero_as(F.col("global_std"), 1.0)
    # fixed values: at least 0.4 deviations, five features per segment
    scored = _segment_means(df, label, columns).withColumn("z", z).where(F.abs("z") >= 0.4)
    order = Window.partitionBy("segment").orderBy(F.desc(F.abs(F.round("z", 2))), "position")
    return (
        scored.withColumn("feature_rank", F.row_number().over(order))
        .where(F.col("feature_rank") <= top)
        .select(
            "segment",
            "feature_rank",
            "feature",
            F.round("z", 2).alias("z_score"),
            F.round("segment_mean", 2).alias("segment_mean"),
            F.round("global_mean", 2).alias("global_mean"),
            F.when(F.col("z") > 0, "higher").otherwise("lower").alias("direction"),
        )
    )


def segment_mean_comparison(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per segment and feature: segment mean, table mean, difference and difference in percent."""
    columns = list(columns or [c for c in numeric_columns(df) if c != label])
    gap = F.col("segment_mean") - F.col("global_mean")
    return _segment_means(df, label, columns).select(
        "segment",
        "feature",
        "segment_mean",
        "global_mean",
        gap.alias("difference"),
        share(gap, F.col("global_mean"), empty=0.0).alias("difference_pct"),
    )


def attach_labels(df: DataFrame, labels: DataFrame, key) -> DataFrame:
    """Original rows with label or score columns beside them; rows without a label keep NULL."""
    return df.join(labels, require_key(df, key), "left")


def silhouette(df: DataFrame, features: str, label: str, method: str = "squared") -> DataFrame:
    """One row, ``silhouette``: the mean over all rows.

    ``squared`` takes squared Euclidean distances; it needs one pass for the
    moments of each cluster and one to score, so it is linear in the rows.
    ``euclidean`` takes plain distances and compares all rows in tiles;
    ``silhouettes.silhouette_interval`` brackets it in linear time.  NULL where
    there are fewer than two labels.
    """
    if method == "euclidean":
        return euclidean_silhouette(df, features, label)
    if method != "squared":
        raise ValueError("method must be squared or euclidean")
    codes = df.select(
        array_to_vector(col(features).cast("array<double>")).alias("features"), col(label).cast("double").alias("code")
    ).where("features IS NOT NULL AND code IS NOT NULL")
    labels = codes.agg(F.min("code").alias("low"), F.max("code").alias("high")).first()
    value = None
    if labels["low"] != labels["high"]:
        value = ClusteringEvaluator(
            featuresCol="features", predictionCol="code", metricName="silhouette", distanceMeasure="squaredEuclidean"
        ).evaluate(codes)
    return df.sparkSession.range(1).select(F.lit(value).cast("double").alias("silhouette"))
