"""Writers for labelled rows and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablescope.operators.segments import attach_labels


def write_labeled_csv(df: DataFrame, labels: DataFrame, key, path: str, mode: str = "errorifexists") -> None:
    """All rows with their label or score columns, as CSV with a header, one file per task."""
    attach_labels(df, labels, key).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Findings or report rows as Parquet or JSON."""
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt must be parquet or json")
    findings.write.mode(mode).format(fmt).save(path)
