"""Columnar table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(path)
