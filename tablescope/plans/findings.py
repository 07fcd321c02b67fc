"""Rule-based findings, summaries and recommendations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablescope.functions.columns import col
from tablescope.operators.anomalies import ANOMALY, anomaly_summary
from tablescope.operators.profile import missing_cells, table_stats
from tablescope.operators.relations import rank_relationships
from tablescope.operators.segments import largest_segment, segment_summary


def _finding(position: int, rule, severity, subject, value: Column, text: Column) -> list[Column]:
    def column(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    return [
        F.lit(position).alias("position"),
        column(rule).alias("rule"),
        column(severity).alias("severity"),
        column(subject).cast("string").alias("subject"),
        value.cast("double").alias("value"),
        text.alias("text"),
    ]


def _top_pairs(relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The strongest pair with r >= 0.5 and the most negative one with r <= -0.5."""
    positive = rank_relationships(relationships.where(F.col("pearson") >= 0.5), 1)
    negative = relationships.where(F.col("pearson") <= -0.5).orderBy("pearson", "var1", "var2").limit(1)
    return positive, negative


def generate_findings(
    df: DataFrame, segment: str | None = None, anomaly: str | None = None, relationships: DataFrame | None = None
) -> DataFrame:
    """``position, rule, severity, subject, value, text``.

    ``segment`` and ``anomaly`` name label columns of ``df`` that are not part
    of the data proper; ``relationships`` comes from ``mine_relationships``.
    """
    data = df.drop(*[c for c in (segment, anomaly) if c])
    pct = F.col("missing_pct")
    # fixed values: above 5 %, and exactly 0
    health = missing_cells(data).where((F.col("n_rows") > 0) & ((pct > 5) | (pct == 0)))
    many = pct > 5
    parts = [
        health.select(
            *_finding(
                1,
                F.when(many, "missing_values").otherwise("complete"),
                F.when(many, "warning").otherwise("good"),
                "dataset",
                pct,
                F.when(
                    many,
                    F.format_string(
                        "%.1f%% of all cells are empty; fill them or leave out the columns concerned.", pct
                    ),
                ).otherwise("No cell is empty."),
            )
        )
    ]
    if segment:
        parts.append(
            largest_segment(df.where(col(segment).isNotNull()), segment).select(
                *_finding(
                    2,
                    "dominant_segment",
                    "info",
                    F.col("segment"),
                    F.col("pct"),
                    F.format_string(
                        "Largest segment: %s, %.1f%% of the rows.", F.col("segment").cast("string"), F.col("pct")
                    ),
                )
            )
        )
    if anomaly:
        n = F.col("anomalies")
        counted = df.agg(F.count(F.when(col(anomaly) == ANOMALY, 1)).alias("anomalies"))
        parts.append(
            counted.select(
                *_finding(
                    3,
                    F.when(n > 0, "anomalies").otherwise("no_anomalies"),
                    F.when(n > 0, "alert").otherwise("good"),
                    "rows",
                    n,
                    F.when(
                        n > 0,
                        F.format_string("%d rows carry the anomaly label.", n),
                    ).otherwise("No row carries the anomaly label."),
                )
            )
        )
    if relationships is not None:
        for position, (kind, word, pairs) in enumerate(
            zip(("positive", "negative"), ("rise together", "move in opposite directions"), _top_pairs(relationships)), start=4
        ):
            parts.append(
                pairs.select(
                    *_finding(
                        position,
                        f"{kind}_pair",
                        "good" if kind == "positive" else "alert",
                        F.concat_ws(" / ", "var1", "var2"),
                        F.col("pearson"),
                        F.format_string(f"%s and %s {word} (r = %.2f).", "var1", "var2", "pearson"),
                    )
                )
            )
    found = reduce(DataFrame.unionAll, parts)
    nothing = found.agg(F.count("*").alias("n")).where("n = 0").select(
        *_finding(
            9,
            "none",
            "info",
            "dataset",
            F.lit(None),
            F.lit("Nothing to report; label segments or anomalies, or pass relationships, for more findings."),
        )
    )
    return found.unionAll(nothing)


def recommend_analyses(scores: DataFrame, by: str | None = None) -> DataFrame:
    """``by, position, title, reason``: at most four recommended analyses per row of scores, and why.

    Reads ``has_date, clusterability, stability, complexity``; a missing score
    never triggers its rule.
    """
    # fixed values: above 45, below 65, above 40
    rules = [
        (F.coalesce(F.col("has_date"), F.lit(False)), "Timeline Intelligence", F.lit("the table has a date column")),
        (F.coalesce(F.col("clusterability") > 45, F.lit(False)), "Segment Discovery", _because("clusterability")),
        (F.coalesce(F.col("stability") < 65, F.lit(False)), "Anomaly Detection", _because("stability")),
        (F.coalesce(F.col("complexity") > 40, F.lit(False)), "Correlation Discovery", _because("complexity")),
    ]

    def entry(title: str, reason: Column) -> Column:
        return F.struct(F.lit(title).alias("title"), reason.cast("string").alias("reason"))

    found = F.array_compact(F.array(*[F.when(test, entry(title, reason)) for test, title, reason in rules]))
    plain = F.array(entry("Dataset DNA Profile", F.lit("no score stands out")))
    keep = [col(by)] if by else []
    listed = scores.select(*keep, F.posexplode(F.when(F.size(found) > 0, found).otherwise(plain)).alias("position", "found"))
    return listed.select(*keep, "position", "found.title", "found.reason")


def _because(score: str) -> Column:
    return F.format_string(f"{score} is %.1f", col(score).cast("double"))


def _item(position: int, section: str, item: str, value: Column, text: Column | None = None) -> list[Column]:
    return [
        F.lit(position).alias("position"),
        F.lit(section).alias("section"),
        F.lit(item).alias("item"),
        value.cast("double").alias("value"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    ]


def executive_summary(
    df: DataFrame,
    segment: str | None = None,
    anomaly: str | None = None,
    score: str | None = None,
    relationships: DataFrame | None = None,
) -> DataFrame:
    """``position, section, item, value, text``: the figures of the overview, label columns excluded from the data."""
    data = df.drop(*[c for c in (segment, anomaly, score) if c])
    stats = table_stats(data)
    parts = [
        stats.select(
            F.inline(
                F.array(
                    F.struct(*_item(1, "Dataset", "rows", F.col("n_rows"))),
                    F.struct(*_item(2, "Dataset", "features", F.col("n_columns"))),
                    F.struct(*_item(3, "Dataset", "missing_pct", F.col("missing_pct"))),
                    F.struct(*_item(4, "Dataset", "duplicate_rows", F.col("duplicate_rows"))),
                )
            )
        )
    ]
    if anomaly and score:
        parts.append(
            anomaly_summary(df, anomaly, score).select(
                F.inline(
                    F.array(
                        F.struct(*_item(5, "Anomalies", "anomalies", F.col("anomalies"))),
                        F.struct(*_item(6, "Anomalies", "max_score", F.col("max_score"))),
                    )
                )
            )
        )
    if segment:
        parts.append(segment_summary(df, segment).select(*_item(7, "Segments", "segments", F.col("segments"))))
        parts.append(
            largest_segment(df, segment).select(*_item(8, "Segments", "largest_segment", F.col("pct"), F.col("segment")))
        )
    if relationships is not None:
        positive, negative = _top_pairs(relationships)
        names = F.concat_ws(" / ", "var1", "var2")
        parts.append(positive.select(*_item(9, "Correlations", "top_positive", F.col("pearson"), names)))
        parts.append(negative.select(*_item(10, "Correlations", "top_negative", F.col("pearson"), names)))
    return reduce(DataFrame.unionAll, parts)


def report_rows(
    df: DataFrame,
    dna: DataFrame | None = None,
    segment: str | None = None,
    anomaly: str | None = None,
    score: str | None = None,
    relationships: DataFrame | None = None,
) -> DataFrame:
    """The overview plus the characterising scores and the five strongest pairs with their wording."""
    parts = [executive_summary(df, segment, anomaly, score, None)]
    if dna is not None:
        parts.append(
            dna.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(*_item(20 + i, "DNA", name, F.col(name)))
                            for i, name in enumerate(["quality", "complexity", "clusterability", "stability"])
                        ]
                    )
                )
            )
        )
    if relationships is not None:
        r = F.col("pearson")
        # fixed values: strictly above 0.7 and 0.4
        size = F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.4, "moderate").otherwise("weak")
        sign = F.when(r > 0, "rising").otherwise("falling")
        text = F.format_string("%s with %s: %s, %s (r = %.2f)", "var1", "var2", size, sign, r)
        parts.append(
            rank_relationships(relationships, 5).select(*_item(30, "Correlations", "pair", r, text))
        )
    return reduce(DataFrame.unionAll, parts)
