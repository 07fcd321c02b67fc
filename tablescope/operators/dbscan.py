"""Exact density clustering on a grid, without listing the pairs of a dense place.

Identical points are merged into one weighted point.  Grid cells are so small
that points of one cell are neighbours; a cell that weighs at least
``min_samples`` therefore consists of core points and is one cluster, and none
of its inner pairs is looked at.  Only points of thin cells (fewer than
``min_samples`` each) are compared with the points around them.  Whether two
dense cells touch is decided by comparing ever smaller boxes.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope.functions.columns import col, require_key
from tablescope.functions.joins import hot_keys, lookup_join, salted_join
from tablescope.operators.features import prepare_features
from tablescope.operators.graph import merged_components
from tablescope.operators.segments import NOISE
from tablescope.session import checkpoint

CHUNK = 3  # grid dimensions matched per join
DIRECT_FACTOR = 20  # point pairs per point below which boxes are not refined further


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _squared_distance(a: str, b: str, d: int) -> Column:
    return _total([(F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(d)])


def _squared_gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str, d: int) -> Column:
    """Smallest squared distance between two boxes."""
    gaps = [
        F.greatest(F.lit(0.0), F.col(lo_b)[i] - F.col(hi_a)[i], F.col(lo_a)[i] - F.col(hi_b)[i]) for i in range(d)
    ]
    return _total([g * g for g in gaps])


def _squared_reach(lo_a: str, hi_a: str, lo_b: str, hi_b: str, d: int) -> Column:
    """Largest squared distance between two boxes."""
    spans = [F.greatest(F.col(hi_b)[i] - F.col(lo_a)[i], F.col(hi_a)[i] - F.col(lo_b)[i]) for i in range(d)]
    return _total([s * s for s in spans])


def _box(d: int) -> list[Column]:
    return [
        F.array(*[F.min(F.col("x")[i]) for i in range(d)]).alias("lo"),
        F.array(*[F.max(F.col("x")[i]) for i in range(d)]).alias("hi"),
        F.count("*").alias("points"),
        F.sum("weight").alias("weight"),
    ]


def _cell_at(d: int, side: float) -> Column:
    return F.array(*[F.floor(F.col("x")[i] / F.lit(side)).cast("bigint") for i in range(d)])


def _near_cells(cells: DataFrame, d: int, reach: int) -> DataFrame:
    """Ordered pairs ``a, b`` of different occupied cells at most ``reach`` apart in every dimension.

    Matches ``CHUNK`` dimensions at a time: pairs of cell prefixes are extended
    by neighbouring continuations only, so the work follows the number of
    neighbouring prefixes and not the number of cells sharing one prefix.
    """
    pairs = None
    for start in range(0, d, CHUNK):
        end = min(d, start + CHUNK)
        place = F.array(*[F.floor(F.col("cell")[i] / reach).cast("bigint") for i in range(start, end)])
        level = cells.select(
            F.slice("cell", 1, start).alias("before"), F.slice("cell", 1, end).alias("prefix"), place.alias("place")
        ).distinct()
        offsets = [F.lit(o).cast("bigint") for o in (-1, 0, 1)]
        around = level
        for i in range(end - start):
            around = around.withColumn(f"o{i}", F.explode(F.array(*offsets)))
        around = around.select(
            F.col("before").alias("before_a"),
            F.col("prefix").alias("a"),
            F.array(*[F.col("place")[i] + F.col(f"o{i}") for i in range(end - start)]).alias("place"),
        )
        right = level.select(F.col("before").alias("before_b"), F.col("prefix").alias("b"), "place")
        if pairs is None:
            joined = around.join(right, "place")
        else:
            before = pairs.select(F.col("a").alias("before_a"), F.col("b").alias("before_b"))
            joined = before.join(around, "before_a").join(right, ["before_b", "place"])
        close = [F.abs(F.col("a")[i] - F.col("b")[i]) <= reach for i in range(start, end)]
        for c in close:
            joined = joined.where(c)
        pairs = joined.select("a", "b")
    return pairs.where("a <> b")


def _touching(
    unsure: DataFrame, points: DataFrame, hot_cells: DataFrame, d: int, eps: float, side: float, n_points: int
) -> DataFrame:
    """Pairs ``left, right`` of dense cells holding two points within ``eps``.

    Boxes are halved round by round: a pair whose boxes lie within ``eps`` of
    each other throughout is settled, one whose boxes are further apart is
    dropped, the rest go on.  When few point pairs are left they are compared.
    """
    limit = eps * eps
    wanted = unsure.select(F.col("left").alias("cell")).union(unsure.select(F.col("right").alias("cell"))).distinct()
    members = checkpoint(lookup_join(points.select("cell", "x", "weight"), wanted, ["cell"], hot_cells, "inner"))
    whole = members.groupBy("cell").agg(*_box(d)).withColumn("part", F.array().cast("array<bigint>"))
    open_pairs = unsure.select("left", "right").withColumns(
        {"part_left": F.array().cast("array<bigint>"), "part_right": F.array().cast("array<bigint>")}
    )
    settled = None
    level, boxes = 0, whole
    while True:
        one = boxes.select(
            F.col("cell").alias("left"), F.col("part").alias("part_left"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
            F.col("points").alias("points_a"),
        )
        two = boxes.select(
            F.col("cell").alias("right"), F.col("part").alias("part_right"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
            F.col("points").alias("points_b"),
        )
        measured = checkpoint(
            open_pairs.join(one, ["left", "part_left"])
            .join(two, ["right", "part_right"])
            .withColumn("gap", _squared_gap("lo_a", "hi_a", "lo_b", "hi_b", d))
            .where(F.col("gap") <= limit)
            .withColumn("sure", _squared_reach("lo_a", "hi_a", "lo_b", "hi_b", d) <= limit)
            .select("left", "right", "part_left", "part_right", "sure", (F.col("points_a") * F.col("points_b")).alias("work"))
        )
        found = measured.where("sure").select("left", "right").distinct()
        settled = found if settled is None else settled.union(found)
        rest = measured.join(found, ["left", "right"], "left_anti")
        work = rest.agg(F.coalesce(F.sum("work"), F.lit(0))).first()[0]
        if work == 0:
            return settled
        part = _cell_at(d, side / 2**level) if level else F.array().cast("array<bigint>")
        if work <= DIRECT_FACTOR * n_points:
            placed = members.withColumn("part", part)
            a = placed.select(F.col("cell").alias("left"), F.col("part").alias("part_left"), F.col("x").alias("xa"))
            b = placed.select(F.col("cell").alias("right"), F.col("part").alias("part_right"), F.col("x").alias("xb"))
            direct = rest.join(a, ["left", "part_left"]).join(b, ["right", "part_right"])
            return settled.union(direct.where(_squared_distance("xa", "xb", d) <= limit).select("left", "right").distinct())
        level += 1
        if level > 40:
            raise ValueError("eps is too small for the precision of the features")
        finer = members.withColumn("parent", part).withColumn("part", _cell_at(d, side / 2**level))
        boxes = finer.groupBy("cell", "parent", "part").agg(*_box(d))
        heirs = boxes.select("cell", "parent", "part")
        open_pairs = (
            rest.join(
                heirs.select(F.col("cell").alias("left"), F.col("parent").alias("part_left"), F.col("part").alias("next_left")),
                ["left", "part_left"],
            )
            .join(
                heirs.select(F.col("cell").alias("right"), F.col("parent").alias("part_right"), F.col("part").alias("next_right")),
                ["right", "part_right"],
            )
            .select("left", "right", F.col("next_left").alias("part_left"), F.col("next_right").alias("part_right"))
        )


def dbscan_points(rows: DataFrame, key: Sequence[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``key..., segment`` for rows that carry a ``features`` array without NULLs."""
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    key = list(key)
    rows = rows.select(*[col(k) for k in key], F.transform("features", lambda v: v + F.lit(0.0)).alias("x"))
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return rows.select(*[col(k) for k in key], F.lit("").alias("segment"))
    d = first["d"]
    side = eps / sqrt(d) * (1 - 1e-9)
    limit = eps * eps
    reach = max(1, ceil(eps / side))
    smallest = F.min(F.struct(*[col(k) for k in key])).alias("first_key")
    points = checkpoint(
        rows.groupBy("x").agg(F.count("*").alias("weight"), smallest).withColumn("cell", _cell_at(d, side))
    )
    cells = checkpoint(points.groupBy("cell").agg(*_box(d)).withColumn("dense", F.col("weight") >= min_samples))
    n_points = points.count()
    hot_cells = checkpoint(cells.where(F.col("points") * 100 >= n_points).select("cell"))  # at most 100 cells
    facts = cells.select("cell", "dense", F.col("weight").alias("inside"))
    points = checkpoint(lookup_join(points, facts, ["cell"], hot_cells, "inner"))

    def named(suffix: str) -> DataFrame:
        return cells.select(*[F.col(c).alias(f"{c}_{suffix}") for c in ("lo", "hi", "weight", "dense")], F.col("cell").alias(suffix))

    pairs = checkpoint(
        _near_cells(cells, d, reach)
        .join(named("a"), "a")
        .join(named("b"), "b")
        .where(_squared_gap("lo_a", "hi_a", "lo_b", "hi_b", d) <= limit)
        .select("a", "b", "dense_a", "dense_b", "lo_b", "hi_b", "weight_b")
    )

    # thin cells: every point against the cells around it
    thin = points.where("NOT dense")
    reachable = (
        thin.select(F.col("cell").alias("a"), F.col("x").alias("xa"))
        .join(pairs.where("NOT dense_a"), "a")
        .where(_squared_gap("xa", "xa", "lo_b", "hi_b", d) <= limit)
        .withColumn("all_near", F.col("dense_b") & (_squared_reach("xa", "xa", "lo_b", "hi_b", d) <= limit))
    )
    by_cell = reachable.where("all_near").select("a", "xa", "b", F.lit(None).cast("array<double>").alias("xb"), F.col("weight_b").alias("near_weight"), "dense_b")
    offered = points.select(F.col("cell").alias("b"), F.col("x").alias("xb"), F.col("weight").alias("near_weight"))
    asking = reachable.where("NOT all_near").select("a", "xa", "b", "dense_b")
    met = salted_join(asking, offered, ["b"], hot_cells.withColumnRenamed("cell", "b"), ["xb"])
    by_point = met.where(_squared_distance("xa", "xb", d) <= limit).select(*by_cell.columns)
    # which points of a dense cell are near does not matter, only that some are and their weight
    by_dense = (
        by_point.where("dense_b")
        .groupBy("a", "xa", "b", "dense_b")
        .agg(F.sum("near_weight").alias("near_weight"))
        .withColumn("xb", F.lit(None).cast("array<double>"))
    )
    near = checkpoint(by_cell.unionByName(by_dense).unionByName(by_point.where("NOT dense_b")))
    around = near.groupBy("a", "xa").agg(F.sum("near_weight").alias("outside"))
    thin_core = checkpoint(
        thin.select(F.col("cell").alias("a"), F.col("x").alias("xa"), "first_key", "inside")
        .join(around, ["a", "xa"], "left")
        .where(F.col("inside") + F.coalesce("outside", F.lit(0)) >= min_samples)
        .select("a", "xa", "first_key")
    )

    # clusters: cells with core points, joined where core points are neighbours
    core_cells = cells.where("dense").select("cell").union(thin_core.select("a")).distinct().withColumnRenamed("cell", "node")
    core_near = near.join(thin_core.select("a", "xa"), ["a", "xa"], "left_semi")
    to_dense = core_near.where("dense_b").select(F.col("a").alias("left"), F.col("b").alias("right"))
    to_thin = (
        core_near.where("NOT dense_b")
        .join(thin_core.select(F.col("a").alias("b"), F.col("xa").alias("xb")), ["b", "xb"], "left_semi")
        .select(F.col("a").alias("left"), F.col("b").alias("right"))
    )
    dense_pairs = pairs.where("dense_a AND dense_b AND a < b").select(F.col("a").alias("left"), F.col("b").alias("right"))
    linked = _touching(checkpoint(dense_pairs), points, hot_cells, d, eps, side, n_points)
    # one row per cell: cluster names are needed twice
    parts = checkpoint(merged_components(core_cells, to_dense.union(to_thin).union(linked).distinct()))

    # names in the order of the smallest key among a cluster's core points
    dense_first = points.where("dense").groupBy("cell").agg(F.min("first_key").alias("first_key"))
    thin_first = thin_core.groupBy("a").agg(F.min("first_key").alias("first_key")).withColumnRenamed("a", "cell")
    firsts = dense_first.union(thin_first).join(parts.withColumnRenamed("node", "cell"), "cell")
    ordered = firsts.groupBy("component").agg(F.min("first_key").alias("first_key"))
    numbered = checkpoint(_number_clusters(ordered))
    cell_cluster = checkpoint(
        parts.join(numbered, "component").select(F.col("node").alias("cell"), "cluster")
    )

    # points of dense cells and thin core points belong to their cell's cluster, others to the first one near
    dense_points = points.where("dense").select("cell", "x")
    dense_labels = lookup_join(dense_points, cell_cluster, ["cell"], hot_cells, "inner").select("x", "cluster")
    core_labels = thin_core.join(cell_cluster.withColumnRenamed("cell", "a"), "a").select(F.col("xa").alias("x"), "cluster")
    border = near.join(thin_core.select("a", "xa"), ["a", "xa"], "left_anti")
    near_thin = border.where("NOT dense_b").join(
        thin_core.select(F.col("a").alias("b"), F.col("xa").alias("xb")), ["b", "xb"], "left_semi"
    )
    near_core = border.where("dense_b").select("a", "xa", "b").union(near_thin.select("a", "xa", "b"))
    inside = (
        thin.select(F.col("cell").alias("a"), F.col("x").alias("xa"))
        .join(thin_core.select("a", "xa"), ["a", "xa"], "left_anti")
        .select("a", "xa", F.col("a").alias("b"))
    )
    border_labels = (
        near_core.union(inside)
        .join(cell_cluster.withColumnRenamed("cell", "b"), "b")
        .groupBy(F.col("xa").alias("x"))
        .agg(F.min("cluster").alias("cluster"))
    )
    labels = checkpoint(dense_labels.union(core_labels).union(border_labels))
    out = lookup_join(rows, labels, ["x"], hot_keys(rows, ["x"]))
    name = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    return out.select(*[col(k) for k in key], F.coalesce(name, F.lit(NOISE)).alias("segment"))


def _number_clusters(ordered: DataFrame) -> DataFrame:
    """Number clusters 0, 1, ... by smallest key; range-partitioned ranks, no single-task sort.

    Clusters are placed in ranges of their first key; the offset of a range is
    the number of clusters in the ranges before it.
    """
    spread = checkpoint(ordered.repartitionByRange("first_key").withColumn("range_id", F.spark_partition_id()))
    sizes = spread.groupBy("range_id").agg(F.count("*").alias("size"))
    before = sizes.select(
        "range_id",
        (F.sum("size").over(Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("offset"),
    )
    inside = F.row_number().over(Window.partitionBy("range_id").orderBy("first_key"))
    return (
        spread.withColumn("inside", inside)
        .join(F.broadcast(before), "range_id")  # one row per partition
        .select("component", (F.col("inside") - 1 + F.col("offset")).alias("cluster"))
    )


def dbscan_segments(
    df: DataFrame, columns: Sequence[str], key, eps: float = 0.5, min_samples: int = 5
) -> DataFrame:
    """``key..., segment``: density clusters of the prepared features, the rest as noise."""
    key = require_key(df, key)
    return dbscan_points(prepare_features(df, columns, key), key, eps, min_samples)
