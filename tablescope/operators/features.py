"""Feature preparation shared by segmentation, anomaly detection and the data map.

Fitting reads bounded facts (medians, category lists, means and deviations);
encoding is then a plain projection over the table.  ``sparse_vector`` has no
bound on the categories: it joins a dictionary of them that stays distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope.functions.columns import clean, col, family, number, require_columns, require_key
from tablescope.functions.dates import as_timestamp
from tablescope.functions.joins import lookup_join
from tablescope.operators.order_stats import quantiles
from tablescope.session import checkpoint

MISSING = "Missing"


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970-01-01 of a date column, read as UTC."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    stamp = as_timestamp(df, name)
    days = F.datediff(F.to_date(stamp), F.to_date(origin)).cast("bigint")
    return days * 86400 + F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.floor(F.second(stamp))


def to_epoch_seconds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.withColumns({c: epoch_seconds(df, c) for c in columns})


def column_medians(df: DataFrame, columns: Sequence[str], approx: bool = False) -> dict[str, float]:
    """Medians of the columns that have gaps, 0 where every value is missing."""
    columns = list(columns)
    if not columns:
        return {}
    gaps = df.agg(*[(F.count("*") - F.count(number(df, c))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    holed = [c for i, c in enumerate(columns) if gaps[i]]
    if not holed:
        return {}
    found = {r["column"]: r["q0"] for r in quantiles(df, holed, [0.5], approx).collect()}  # one row per column
    return {c: found.get(c, 0.0) for c in holed}


def impute_median(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Numeric columns as double with gaps filled by the median, exact or estimated from a sketch."""
    medians = column_medians(df, require_columns(df, columns), approx)
    return df.withColumns(
        {c: F.coalesce(number(df, c), F.lit(medians[c])) if c in medians else number(df, c) for c in columns}
    )


def impute_missing_label(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text of non-numeric columns with gaps filled by "Missing"."""
    require_columns(df, columns)
    return df.withColumns({c: F.coalesce(clean(df, c).cast("string"), F.lit(MISSING)) for c in columns})


def category_lists(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted categories of each column, missing ones included as "Missing".

    Categories become columns, so their number is checked against Spark's own
    limit on pivoted columns before any list is read.
    """
    columns = list(columns)
    if not columns:
        return {}
    text = impute_missing_label(df.select(*[col(c) for c in columns]), columns)
    values = text.unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    for r in values.groupBy("column").agg(F.count("*").alias("k")).collect():  # one row per column
        if r["k"] > limit:
            raise ValueError(
                f"column {r['column']!r} has {r['k']} categories; at most {limit} can become columns, use sparse_vector"
            )
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in values.select("column", "value").collect():
        found[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in found.items()}


@dataclass
class FeaturePlan:
    """How to turn rows into numbers: fitted once, applied as a projection."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    categories: dict[str, list[str]]
    means: list[float] = field(default_factory=list)
    deviations: list[float] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        dummies = [f"{c}_{v}" for c in self.categorical for v in self.categories[c][1:]]
        return self.numeric + dummies

    def raw(self, df: DataFrame) -> list[Column]:
        out = []
        for c in self.numeric:
            value = epoch_seconds(df, c).cast("double") if family(df.schema[c].dataType) == "datetime" else number(df, c)
            out.append(F.coalesce(value, F.lit(self.medians[c])) if c in self.medians else value)
        for c in self.categorical:
            text = F.coalesce(clean(df, c).cast("string"), F.lit(MISSING))
            out += [(text == v).cast("double") for v in self.categories[c][1:]]
        return out

    def scaled(self, df: DataFrame) -> list[Column]:
        return [(x - F.lit(m)) / F.lit(s) for x, m, s in zip(self.raw(df), self.means, self.deviations)]


def fit_features(df: DataFrame, columns: Sequence[str], scale: bool = True) -> FeaturePlan:
    """Medians, categories and scaler moments of the selected columns."""
    columns = require_columns(df, columns)
    kinds = {c: family(df.schema[c].dataType) for c in columns}
    numeric = [c for c in columns if kinds[c] in ("numeric", "datetime")]
    categorical = [c for c in columns if kinds[c] == "categorical"]
    dates = [c for c in numeric if kinds[c] == "datetime"]
    dated = to_epoch_seconds(df, dates) if dates else df
    plan = FeaturePlan(numeric, categorical, column_medians(dated, numeric), category_lists(df, categorical))
    if not plan.names:
        raise ValueError("no usable feature is left")
    if scale:
        raw = df.select(*[x.alias(f"f{i}") for i, x in enumerate(plan.raw(df))])
        moments = raw.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in raw.columns]).first()
        plan.means = [m[0] if m[0] is not None else 0.0 for m in moments]
        plan.deviations = [m[1] or 1.0 for m in moments]
    return plan


def one_hot(df: DataFrame, columns: Sequence[str], key) -> DataFrame:
    """Numeric columns first, then 0/1 columns for all but the first category of each other column."""
    key = require_key(df, key)
    plan = fit_features(df, columns, scale=False)
    return df.select(*[col(k) for k in key], *[x.alias(n) for x, n in zip(plan.raw(df), plan.names)])


def standardize(df: DataFrame, columns: Sequence[str], key) -> DataFrame:
    """Encoded columns less their mean over their population deviation (0 counts as 1)."""
    key = require_key(df, key)
    plan = fit_features(df, columns)
    return df.select(*[col(k) for k in key], *[x.alias(n) for x, n in zip(plan.scaled(df), plan.names)])


def prepare_features(df: DataFrame, columns: Sequence[str], key) -> DataFrame:
    """``key..., features``: the standardised features as one array."""
    key = require_key(df, key)
    plan = fit_features(df, columns)
    return df.select(*[col(k) for k in key], F.array(*plan.scaled(df)).alias("features"))


def feature_vector(df: DataFrame, columns: Sequence[str], key) -> DataFrame:
    """``key..., features`` as an ML vector."""
    key = require_key(df, key)
    plan = fit_features(df, columns)
    names = [f"f{i}" for i in range(len(plan.names))]
    wide = df.select(*[col(k) for k in key], *[x.alias(n) for x, n in zip(plan.scaled(df), names)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).select(*key, "features")


def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n, place``: every category with its rows and its place in sorted order, missing ones as "Missing".

    The categories are range-partitioned; a place is the place within the range
    plus the categories in the ranges before.  Written once, never collected.
    """
    columns = require_columns(df, columns)
    text = impute_missing_label(df.select(*[col(c) for c in columns]), columns)
    values = text.unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    ranged = checkpoint(values.repartitionByRange("column", "value").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("column", "range").agg(F.count("*").alias("held"))  # one row per column and task
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("column", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("column", "range").orderBy("value"))
    placed = ranged.withColumn("inside", inside).join(F.broadcast(starts), ["column", "range"])
    return placed.select("column", "value", "n", (F.col("start") + F.col("inside") - 1).alias("place"))


def sparse_vector(df: DataFrame, columns: Sequence[str], key) -> DataFrame:
    """``key..., features``: the prepared features as sparse ML vectors, for any number of categories.

    Numeric columns come first, standardised as in ``feature_vector``.  A
    category holds one over its deviation in its own slot and nothing elsewhere:
    its mean is left out, which shifts all rows alike, so distances, variances
    and principal axes are those of the centred features while the vectors stay
    sparse.  The first category of a column has no slot.

    Categories are looked up in ``category_index``; those that hold 1 % of the
    rows or more, at most 100 a column, are broadcast, so a frequent one leaves
    its rows where they are.
    """
    key = require_key(df, key)
    columns = require_columns(df, columns)
    kinds = {c: family(df.schema[c].dataType) for c in columns}
    numeric = [c for c in columns if kinds[c] in ("numeric", "datetime")]
    categorical = [c for c in columns if kinds[c] == "categorical"]
    scaled = []
    if numeric:
        plan = fit_features(df, numeric)
        scaled = plan.scaled(df)
    texts = [F.coalesce(clean(df, c).cast("string"), F.lit(MISSING)) for c in categorical]
    rows = df.select(
        *[col(k) for k in key],
        F.array(*scaled).cast("array<double>").alias("__numbers"),
        *[t.alias(f"__text{i}") for i, t in enumerate(texts)],
    )
    width = len(numeric)
    if categorical:
        index = checkpoint(category_index(df, categorical))
        facts = {r["column"]: r for r in index.groupBy("column").agg(F.count("*").alias("k"), F.sum("n").alias("rows")).collect()}
        for i, c in enumerate(categorical):  # one row per column
            if c not in facts:  # no rows at all
                continue
            total = F.lit(float(facts[c]["rows"]))
            spread = F.sqrt(F.col("n") / total * (1 - F.col("n") / total))
            entry = F.struct(
                (F.col("place") - 1 + width).cast("int").alias("slot"),
                F.when(spread > 0, 1 / spread).otherwise(1.0).alias("value"),
            )
            own = index.where(F.col("column") == c)
            look = own.select(F.col("value").alias(f"__text{i}"), F.when(F.col("place") > 0, entry).alias(f"__entry{i}"))
            hot = own.where(F.col("n") * 100 >= total).select(F.col("value").alias(f"__text{i}"))
            rows = lookup_join(rows, look, [f"__text{i}"], hot, how="inner")
            width += facts[c]["k"] - 1
    if not width:
        raise ValueError("no usable feature is left")
    size = width

    def vectors(slots: pa.Array, values: pa.Array) -> pa.Array:
        n = len(slots)
        kind, sizes = pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32())
        return pa.StructArray.from_arrays([kind, sizes, slots, values], names=["type", "size", "indices", "values"])

    entries = [F.col(c) for c in rows.columns if c.startswith("__entry")]
    found = F.array_compact(F.array(*entries)) if entries else F.array().cast("array<struct<slot:int,value:double>>")
    own = F.transform("__numbers", lambda x, i: F.struct(i.alias("slot"), x.alias("value")))
    rows = rows.withColumn("__all", F.concat(own, found))
    build = F.arrow_udf(vectors, VectorUDT())
    return rows.select(*[col(k) for k in key], build(F.col("__all.slot"), F.col("__all.value")).alias("features"))
