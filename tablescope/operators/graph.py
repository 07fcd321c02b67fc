"""Connected components of an undirected graph."""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablescope.functions.joins import hot_keys, lookup_join
from tablescope.session import checkpoint

TASK_EDGES = 1 << 20  # edges that one task holds


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: each component is named by its smallest node.

    ``nodes`` has a column ``node``, ``edges`` columns ``left`` and ``right``.
    Each round takes the smallest label among the neighbours and then the label
    of that label, so long chains shrink fast.  Every round is checkpointed.
    """
    both = checkpoint(
        edges.select("left", "right").unionAll(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()
    )
    hot_right = checkpoint(hot_keys(both.select(F.col("right").alias("node")), ["node"]))
    labels = checkpoint(nodes.select("node", F.col("node").alias("component")))
    while True:
        around = (
            lookup_join(both.select("left", F.col("right").alias("node")), labels, ["node"], hot_right, "inner")
            .groupBy("left")
            .agg(F.min("component").alias("nearest"))
        )
        hooked = labels.join(around, labels["node"] == around["left"], "left").select(
            "node", F.col("component").alias("old"), F.least("component", "nearest").alias("step")
        )
        hooked = checkpoint(hooked)
        targets = hooked.select(F.col("node").alias("step"), F.col("step").alias("component"))
        jumped = lookup_join(hooked, targets, ["step"], hot_keys(hooked, ["step"]), "inner")
        jumped = checkpoint(jumped.select("node", "old", "component"))
        labels = jumped.select("node", "component")
        if jumped.where("old <> component").limit(1).count() == 0:
            return labels


def _smallest(edges: list[tuple]) -> dict:
    """Every node of the edges with the smallest node of its component."""
    root: dict = {}

    def find(node):
        top = node
        while root[top] != top:
            top = root[top]
        while root[node] != top:
            root[node], node = top, root[node]
        return top

    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {node: find(node) for node in root}


def merged_components(nodes: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, component`` as ``connected_components``, by union-find in the tasks.

    Edges are dealt to ranges of their smaller node, so neighbouring nodes meet.
    Each task joins its edges completely; a node of several ranges then links the
    names it got there, and these links, far fewer, are the edges of the next
    round.  The round whose edges fit into one task is the last.  Nodes are
    numbers, texts or arrays of them.
    """
    kind = edges.schema["left"].dataType
    listed = isinstance(kind, T.ArrayType)
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])

    def join(batches):
        held = []
        for batch in batches:
            left, right = (batch.column(i).to_pylist() for i in (0, 1))
            held += zip(map(tuple, left), map(tuple, right)) if listed else zip(left, right)
        found = _smallest(held)
        for names, arrow in ((found, batch.schema.field(0).type),) if found else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(x) if listed else x for x in side], arrow) for side in (names.keys(), names.values())],
                names=["node", "root"],
            )

    open_ = edges.where("left <> right").select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"))
    open_ = checkpoint(open_)
    labels = None
    while True:
        tasks = ceil(open_.count() / task_edges)
        if not tasks:
            break
        dealt = open_.repartition(1) if tasks == 1 else open_.repartitionByRange(tasks, "left")
        found = checkpoint(dealt.mapInArrow(join, schema))
        least = found.groupBy("node").agg(F.min("root").alias("least"))
        if labels is None:
            labels = least.withColumnRenamed("least", "component")
        else:
            step = least.withColumnRenamed("node", "component")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
        labels = checkpoint(labels)
        if tasks == 1:
            break
        links = found.join(least, "node").where("root <> least").select(F.col("least").alias("left"), F.col("root").alias("right"))
        open_ = checkpoint(links.distinct())
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
