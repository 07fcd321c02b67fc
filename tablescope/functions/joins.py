"""Joins that keep their balance when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def hot_keys(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that hold at least 1 % of the rows: by arithmetic at most 100 of them."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.where(F.col("n") * 100 >= total).select(*on)


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """Join rows to a lookup table with unique keys.

    The lookup entries of the hot keys are broadcast, so their rows stay where
    they are; only the remaining rows are shuffled by key.
    """
    on = list(on)
    few = F.broadcast(hot)
    hot_part = rows.join(F.broadcast(lookup.join(few, on, "left_semi")), on)
    cold_part = rows.join(few, on, "left_anti").join(lookup, on, how)
    return hot_part.unionByName(cold_part)


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame, spread: Sequence[str], salts: int = 32
) -> DataFrame:
    """Inner join whose right side may hold very many rows of the few hot keys.

    Right rows of a hot key are dealt to ``salts`` parts by the hash of their
    ``spread`` columns and the matching left rows are repeated for every part;
    all other keys join as usual.
    """
    on = list(on)
    few = F.broadcast(hot)
    repeated = left.join(few, on, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = right.join(few, on, "left_semi").withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    hot_part = repeated.join(dealt, [*on, "salt"]).drop("salt")
    cold_part = left.join(few, on, "left_anti").join(right.join(few, on, "left_anti"), on)
    return hot_part.unionByName(cold_part)
