"""Anomaly scores, labels and explanations for rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tablescope.functions.columns import beside, clean, col, number, numeric_columns, require_columns, require_key
from tablescope.functions.joins import hot_keys, lookup_join
from tablescope.functions.numbers import share, zero_as
from tablescope.operators.describe import column_moments
from tablescope.operators.order_stats import quantile_scalar, quantiles
from tablescope.operators.segments import NOISE

ANOMALY, NORMAL = "Anomaly", "Normal"


def normalize_scores(df: DataFrame, raw: str = "raw_score", out: str = "anomaly_score") -> DataFrame:
    """Min-max to 0..1; all 0 when the scores are constant."""
    ends = df.agg(F.min(number(df, raw)).alias("score_low"), F.max(number(df, raw)).alias("score_high"))
    wide = beside(df, ends)
    span = F.col("score_high") - F.col("score_low")
    scaled = F.coalesce(F.try_divide(number(df, raw) - F.col("score_low"), span), F.lit(0.0))
    return wide.withColumn(out, F.when(col(raw).isNotNull(), scaled)).drop("score_low", "score_high")


def contamination_labels(
    df: DataFrame, score: str = "anomaly_score", contamination: float = 0.05, out: str = "is_anomaly", approx: bool = False
) -> DataFrame:
    """Rows above the (1 - contamination) quantile of the score, exact or from a sketch, are anomalies."""
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must lie in (0, 0.5]")
    threshold = quantile_scalar(df, score, 1 - contamination, approx)
    return df.withColumn(out, F.when(number(df, score) > threshold, ANOMALY).otherwise(NORMAL))


def scored_labels(
    df: DataFrame,
    raw: str = "raw_score",
    contamination: float = 0.05,
    score: str = "anomaly_score",
    out: str = "is_anomaly",
    approx: bool = False,
) -> DataFrame:
    """``normalize_scores`` and ``contamination_labels`` in one.

    Scaling keeps the order, so the threshold is taken from the raw scores, with
    the ends from the same two scans.
    """
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must lie in (0, 0.5]")
    facts = quantiles(df, [raw], [1 - contamination], approx).first()
    low, high, limit = (facts["min"], facts["max"], facts["q0"]) if facts else (0.0, 0.0, 0.0)
    value = number(df, raw)
    scaled = (value - F.lit(low)) / F.lit(high - low) if high > low else F.lit(0.0)
    label = F.when(value > F.lit(limit), ANOMALY).otherwise(NORMAL)
    return df.select("*", F.when(value.isNotNull(), scaled).alias(score), label.alias(out))


def anomaly_summary(df: DataFrame, label: str = "is_anomaly", score: str = "anomaly_score") -> DataFrame:
    """Anomalies, their share, clean rows, highest score."""
    hits = F.count(F.when(col(label) == ANOMALY, 1))
    return df.agg(
        hits.alias("anomalies"),
        share(hits, F.count("*"), empty=0.0).alias("anomaly_pct"),
        (F.count("*") - hits).alias("clean_rows"),
        F.max(number(df, score)).alias("max_score"),
    )


def filter_by_anomaly(df: DataFrame, view: str = "all", label: str = "is_anomaly") -> DataFrame:
    """All rows, only anomalies, or only normal rows."""
    if view == "all":
        return df
    if view not in ("anomalies", "normal"):
        raise ValueError("view must be all, anomalies or normal")
    return df.where(col(label) == (ANOMALY if view == "anomalies" else NORMAL))


def top_anomalies(df: DataFrame, key, label: str = "is_anomaly", score: str = "anomaly_score", top: int = 10) -> DataFrame:
    """The anomalous rows with the highest scores (a top-k report)."""
    key = require_key(df, key)
    return filter_by_anomaly(df, "anomalies", label).orderBy(col(score).desc(), *[col(k) for k in key]).limit(top)


def explain_anomalies(
    df: DataFrame,
    flagged: DataFrame,
    key,
    columns: Sequence[str] | None = None,
    segment: str | None = None,
) -> DataFrame:
    """Why rows stand out: features at least 1.5 deviations from their segment's, or the table's, mean.

    ``reason_rank`` numbers a row's features by the size of their deviation.

    ``flagged`` holds rows of ``df`` (with its segment column if one is named);
    noise rows and rows without a segment are compared with the whole table.
    Only per-segment moments are joined to the flagged rows.
    """
    key = require_key(df, key)
    columns = list(columns or [c for c in numeric_columns(df) if c not in key and c != segment])
    require_columns(df, columns)
    whole = column_moments(df, columns).select(
        F.col("column").alias("feature"), F.col("mean").alias("whole_mean"), F.col("std").alias("whole_std")
    )
    group = clean(flagged, segment).cast("string") if segment else F.lit(None).cast("string")
    wide = flagged.select(
        *[col(k) for k in key],
        F.when(group != NOISE, group).alias("group_key"),
        *[number(flagged, c).alias(c) for c in columns],
    )
    long = wide.unpivot([*key, "group_key"], columns, "feature", "value").where("value IS NOT NULL")
    joined = long.join(F.broadcast(whole), "feature")  # one row per column
    blank = {"own_mean": F.lit(None).cast("double"), "own_std": F.lit(None).cast("double")}
    if segment:
        base = df.select(clean(df, segment).cast("string").alias("group_key"), *[number(df, c).alias(c) for c in columns])
        moments = base.groupBy("group_key").agg(
            *[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("own_mean"), F.stddev_samp(c).alias("own_std")).alias(c) for c in columns]
        )
        own = moments.where("group_key IS NOT NULL").select("group_key", F.inline(F.array(*[col(c) for c in columns])))
        # a segment may hold most of the flagged rows; rows without one need no lookup
        named = joined.where("group_key IS NOT NULL")
        on = ["group_key", "feature"]
        joined = joined.where("group_key IS NULL").withColumns(blank).unionByName(lookup_join(named, own, on, hot_keys(named, on)))
    else:
        joined = joined.withColumns(blank)
    grouped = F.col("group_key").isNotNull()
    mean = F.when(grouped, F.col("own_mean")).otherwise(F.col("whole_mean"))
    std = zero_as(F.when(grouped, F.col("own_std")).otherwise(F.col("whole_std")), 1.0)
    # at most one row per column and key
    order = Window.partitionBy(*[col(k) for k in key]).orderBy(F.abs("z").desc(), "feature")
    # fixed value: 1.5 deviations
    return (
        joined.withColumn("group_mean", mean)
        .withColumn("z", (F.col("value") - mean) / std)
        .where(F.abs("z") >= 1.5)
        .select(
            *key,
            "feature",
            F.round("value", 2).alias("value"),
            F.round("group_mean", 2).alias("group_mean"),
            F.round("z", 2).alias("z_score"),
            F.when(F.col("z") > 0, "higher").otherwise("lower").alias("direction"),
            F.when(grouped, F.concat(F.lit("Cluster '"), F.col("group_key"), F.lit("'")))
            .otherwise("Global Dataset")
            .alias("group_label"),
            F.row_number().over(order).alias("reason_rank"),
        )
    )
