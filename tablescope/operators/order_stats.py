"""Exact quantiles and average ranks that never sort a whole column in one task.

``percentile`` keeps every distinct value of a group in one buffer.  Here a
sketch first brackets the wanted order statistics to a sliver of the column;
a second scan counts the rows below the bracket and keeps only the values
inside it.  Neither scan shuffles more than the sliver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope.functions.columns import col, literal_rows, number, require_columns
from tablescope.operators.sketches import quantile_sketches, quantiles_of

RANK_ERROR = 1e-4
SLOTS = 64
COLUMNS_PER_PASS = 50
BUCKET_ROWS = 1_000_000  # rows that are ranked in one task, about
LEAST_BUCKETS, MOST_BUCKETS = 256, 4096


def melt_numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., column, value``: one row per non-missing numeric cell."""
    wide = df.select(*[col(k) for k in keep], *[number(df, c).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), "column", "value").where("value IS NOT NULL")


def _brackets(numbers: DataFrame, probs: Sequence[float], slack: float) -> list[dict]:
    """Per column: count, extremes and a sketch bracket for every probability.

    One job that returns a single row.  Small columns are bracketed by their
    extremes, so the sketch's one-rank uncertainty cannot matter; they hold at
    most ``10 / slack`` values.
    """
    edges = []
    for p in probs:
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    accuracy = int(round(5 / slack))
    facts = numbers.agg(
        *[
            F.struct(
                F.count(c).alias("n"),
                F.min(c).alias("min"),
                F.max(c).alias("max"),
                F.percentile_approx(c, edges, accuracy).alias("edges"),
            ).alias(c)
            for c in numbers.columns
        ]
    ).first()
    out = []
    for c in numbers.columns:
        n, least, most, found = facts[c]
        if n * slack < 10:
            ends = [(least, most)] * len(probs)
        else:
            ends = list(zip(found[0::2], found[1::2]))
        out.append({"n": n, "min": least, "max": most, "ends": ends})
    return out


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], approx: bool = False) -> DataFrame:
    """``exact_quantiles``, or estimates of the same form from one scan (``sketches``)."""
    if approx:
        return quantiles_of(quantile_sketches(df, columns), probs)
    return exact_quantiles(df, columns, probs)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], rank_error: float = RANK_ERROR
) -> DataFrame:
    """Exact linear-interpolation quantiles: ``column, n, min, max, q0, q1, ...``.

    Columns without any value give no row.  A first job sketches the brackets;
    the returned plan scans the columns once with the brackets as literals, and
    shuffles only the values inside them (about ``10 * rank_error`` of a
    column).  Inside a bracket values are ranked slot by slot, not in one sort.
    """
    columns = require_columns(df, columns)
    frames = [
        _quantiles(df, columns[start : start + COLUMNS_PER_PASS], probs, 5 * rank_error)
        for start in range(0, len(columns), COLUMNS_PER_PASS)
    ]
    return reduce(DataFrame.unionAll, frames)


def _quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], slack: float) -> DataFrame:
    numbers = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    facts = _brackets(numbers, probs, slack)
    which = [(i, j) for i in range(len(columns)) if facts[i]["n"] for j in range(len(probs))]
    kinds = "column string, n bigint, min double, max double, " + ", ".join(f"q{j} double" for j in range(len(probs)))
    if not which:
        return df.sparkSession.createDataFrame([], kinds)

    def below(i: int, j: int) -> Column:
        return F.col(f"v{i}") < F.lit(facts[i]["ends"][j][0])

    def within(i: int, j: int) -> Column:
        low, high = facts[i]["ends"][j]
        return F.col(f"v{i}").between(F.lit(low), F.lit(high))

    def slot(i: int, j: int) -> Column:
        low, high = facts[i]["ends"][j]
        step = (F.col(f"v{i}") - F.lit(low)) / F.lit(high - low) * SLOTS if high > low else F.lit(0.0)
        return F.least(F.lit(SLOTS), F.floor(step)).cast("int")

    wanted = literal_rows(
        df.sparkSession,
        [[F.lit(i), F.lit(j), F.lit(probs[j] * (facts[i]["n"] - 1))] for i, j in which],
        ["place", "which", "position"],
    ).withColumn("rank", F.floor("position"))

    # one scan: a value below its bracket only counts, in slot -1
    def cell(i: int, j: int) -> Column:
        mark = lambda s, v: F.struct(F.lit(i).alias("place"), F.lit(j).alias("which"), s.alias("slot"), v.alias("value"))
        outside = mark(F.lit(-1), F.lit(None).cast("double"))
        return F.when(below(i, j), outside).when(within(i, j), mark(slot(i, j), F.col(f"v{i}")))

    keys = ["place", "which", "slot"]
    counted = (
        numbers.select(F.inline(F.array_compact(F.array(*[cell(i, j) for i, j in which]))))
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("rows"))
    )
    by_slot = Window.partitionBy("place", "which").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = (
        counted.groupBy(*keys)
        .agg(F.sum("rows").alias("in_slot"))
        .withColumn("before", F.sum("in_slot").over(by_slot) - F.col("in_slot"))
        .drop("in_slot")
    )
    in_slot = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    # slots: at most SLOTS + 2 rows per column and probability; wanted: one
    ranked = (
        counted.withColumn("upto", F.sum("rows").over(in_slot))
        .join(F.broadcast(slots), keys)
        .join(F.broadcast(wanted), ["place", "which"])
        .withColumn("upto", F.col("upto") + F.col("before"))
    )
    inside = F.col("slot") >= 0
    found = ranked.groupBy("place", "which").agg(
        *[F.first(c).alias(c) for c in ("position", "rank")],
        F.coalesce(F.sum(F.when(~inside, F.col("rows"))), F.lit(0)).alias("below"),
        F.min(F.when(inside & (F.col("upto") > F.col("rank")), F.col("value"))).alias("at"),
        F.min(F.when(inside & (F.col("upto") > F.col("rank") + 1), F.col("value"))).alias("next"),
    )
    between = F.col("position") - F.col("rank")
    missed = (F.col("below") > F.col("rank")) | F.col("at").isNull() | ((between > 0) & F.col("next").isNull())
    upper = F.coalesce(F.col("next"), F.col("at"))
    exact = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")).otherwise(
        F.col("at") + (upper - F.col("at")) * between
    )
    by_column = found.groupBy("place").agg(
        *[F.max(F.when(F.col("which") == j, exact)).alias(f"q{j}") for j in range(len(probs))]
    )
    names = literal_rows(
        df.sparkSession,
        [
            [F.lit(i), F.lit(columns[i]), F.lit(f["n"]).cast("bigint"), F.lit(f["min"]), F.lit(f["max"])]
            for i, f in enumerate(facts)
            if f["n"]
        ],
        ["place", "column", "n", "min", "max"],
    )
    return by_column.join(F.broadcast(names), "place").drop("place").select(
        "column", "n", "min", "max", *[f"q{j}" for j in range(len(probs))]
    )


def quantile_scalar(df: DataFrame, column: str, p: float, approx: bool = False) -> Column:
    """One quantile as a scalar subquery."""
    return quantiles(df, [column], [p], approx).select("q0").scalar()


def _edges(df: DataFrame, columns: Sequence[str], buckets: int) -> list[list[float]]:
    """Per column the sketch quantiles that divide its rows; a value that is several of them gets a bucket of its own."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.agg(*[F.percentile_approx(col(c), probs, 10 * buckets).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    out = []
    for values in found:
        values = values or [0.0]
        frequent = {a for a, b in zip(values, values[1:]) if a == b}
        out.append(sorted({*values, *(math.nextafter(v, math.inf) for v in frequent)} - {math.inf, -math.inf}))
    return out


def row_ranks(df: DataFrame, views: dict[str, tuple[str, Column]], rows: int) -> DataFrame:
    """Each row of ``df`` with the average rank of its value in every view, null where the view has no value.

    A view is a column of doubles without NaN, possibly null in more rows than
    the column; ``views`` gives the column and the values.  Sketch quantiles cut
    each column into buckets whose sizes one aggregate counts.  In a bucket of
    one value the rank is known; all other rows are ranked inside their bucket
    and moved up by the rows of the buckets before.  The ranks stay beside the
    row: a view with a bucket of several values shuffles every row once, any
    other view shuffles nothing.  Rows whose rank is known are dealt evenly, so a
    frequent value is never gathered in one task.  Only edges and bucket counts
    pass through the driver, at most ``2 * MOST_BUCKETS`` per view.
    """
    columns = list(dict.fromkeys(c for c, _ in views.values()))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, rows // BUCKET_ROWS))
    out = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    for c, edges in zip(columns, _edges(df, columns, buckets)):
        splits = [-math.inf, *edges, math.inf]
        out = Bucketizer(splits=splits, inputCol=c, outputCol=f"{c}__bucket", handleInvalid="keep").transform(out)
    cells = [
        F.struct(F.lit(k).alias("view"), F.col(f"{c}__bucket").cast("int").alias("bucket"), value.alias("value"))
        for k, (c, value) in enumerate(views.values())
    ]
    counts = out.select(F.inline(F.array(*cells))).where("value IS NOT NULL").groupBy("view", "bucket")
    facts: list[dict[int, tuple[int, bool]]] = [{} for _ in views]
    for r in counts.agg(F.count("*").alias("n"), (F.min("value") == F.max("value")).alias("single")).collect():
        facts[r["view"]][r["bucket"]] = (r["n"], r["single"])
    for k, (name, (c, value)) in enumerate(views.items()):
        before, start, known, shared = 0, [], [], False
        for b in range(max(facts[k], default=-1) + 1):
            n, single = facts[k].get(b, (0, True))
            start.append(float(before))
            known.append(before + (n + 1) / 2 if single else None)
            shared |= not single
            before += n
        bucket = F.col(f"{c}__bucket").cast("int")
        rank = F.get(F.lit(known).cast("array<double>"), bucket) if known else F.lit(None).cast("double")
        rank = F.when(value.isNotNull(), rank)
        if shared:
            out = out.withColumn("__known", rank)
            settled = F.col("__known").isNotNull() | value.isNull()
            group = F.when(settled, -1 - F.col("__salt")).otherwise(bucket)
            order = Window.partitionBy(group).orderBy(value)
            # rows up to the first and up to the last equal value
            within = (F.rank().over(order) + F.count("*").over(order)) / 2
            rank = F.when(settled, F.col("__known")).otherwise(F.get(F.lit(start), bucket) + within)
        out = out.withColumn(name, rank)
    return out.select(*df.columns, *views)
