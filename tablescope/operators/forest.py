"""Isolation forest: small random trees built per group, scored in vectorised batches."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablescope.functions.columns import col, require_key
from tablescope.operators.anomalies import scored_labels
from tablescope.operators.features import prepare_features
from tablescope.session import checkpoint

# fixed values: trees, rows per tree, seed
TREES, SUBSAMPLE, SEED = 100, 256, 42
LEAST_ROWS = 5

NODE_TYPE = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("path", T.DoubleType()),
        T.StructField("sampled", T.IntegerType()),
    ]
)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _subsamples(features: DataFrame, key: Sequence[str], trees: int, seed: int) -> DataFrame:
    """``tree, place, features``: 256 rows for every tree (all rows of a smaller table).

    Each tree takes the rows with the smallest hashes of key and tree, at any
    size of the table and on any partitioning.  A task keeps its 256 smallest per
    tree, so no more than those are shuffled.
    """
    if features.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"an isolation forest needs at least {LEAST_ROWS} rows")
    rows = features.select(F.xxhash64(*[col(k) for k in key], F.lit(seed)).alias("draw"), "features")
    codes = _scrambled(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def smallest(batches):
        draws = [np.zeros(0, np.uint64) for _ in range(trees)]
        points: list[np.ndarray | None] = [None] * trees
        for batch in batches:
            if not len(batch):
                continue
            hashes = batch["draw"].to_numpy().astype(np.int64).view(np.uint64)
            x = np.array(batch["features"].tolist(), dtype=float)
            for tree in range(trees):
                draw = _scrambled(hashes ^ codes[tree])
                full = len(draws[tree]) >= SUBSAMPLE
                near = np.flatnonzero(draw <= draws[tree].max()) if full else np.arange(len(draw))
                if len(near):
                    found = np.concatenate([draws[tree], draw[near]])
                    rows = x[near] if points[tree] is None else np.concatenate([points[tree], x[near]])
                    keep = np.lexsort((*rows.T[::-1], found))[:SUBSAMPLE]
                    draws[tree], points[tree] = found[keep], rows[keep]
        for tree in range(trees):
            if len(draws[tree]):
                # the order of signed numbers is that of the unsigned ones
                signed = (draws[tree] ^ np.uint64(1 << 63)).view(np.int64)
                yield pd.DataFrame({"tree": np.int32(tree), "draw": signed, "features": list(points[tree])})

    held = rows.mapInPandas(smallest, "tree int, draw bigint, features array<double>")
    order = Window.partitionBy("tree").orderBy("draw", "features")
    return held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SUBSAMPLE).select("tree", "place", "features")


def isolation_forest_fit(features: DataFrame, key, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Node table of the forest (at most 511 rows per tree) from ``key..., features``."""
    key = require_key(features, key)

    def average_path(n: int) -> float:
        if n <= 1:
            return 0.0
        return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def build(sample: pd.DataFrame) -> pd.DataFrame:
        """One tree: split on a random varying feature at a random value until alone or too deep."""
        sample = sample.sort_values("place")
        tree = int(sample["tree"].iloc[0])
        x = np.array(sample["features"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, tree])
        deepest = ceil(log2(max(len(x), 2)))
        nodes: list[list] = []
        waiting = [(np.arange(len(x)), 0, None, None)]
        while waiting:
            rows, depth, parent, side = waiting.pop()
            at = len(nodes)
            nodes.append([tree, at, -1, 0.0, -1, -1, depth + average_path(len(rows)), len(x)])
            if parent is not None:
                nodes[parent][side] = at
            low, high = x[rows].min(0), x[rows].max(0)
            varying = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) <= 1 or not len(varying):
                continue
            feature = int(rng.choice(varying))
            cut = float(rng.uniform(low[feature], high[feature]))
            nodes[at][2:4] = [feature, cut]
            goes_left = x[rows, feature] <= cut
            waiting.append((rows[~goes_left], depth + 1, at, 5))
            waiting.append((rows[goes_left], depth + 1, at, 4))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path", "sampled"])

    return _subsamples(features, key, trees, seed).groupBy("tree").applyInPandas(build, NODE_TYPE)


def isolation_forest_score(features: DataFrame, nodes: DataFrame, key) -> DataFrame:
    """``key..., raw_score``: 2 to the minus (mean path over expected path); higher is more anomalous.

    The forest, at most 511 nodes per tree, is collected and broadcast.
    """
    key = require_key(features, key)
    forest = nodes.orderBy("tree", "node").toPandas()
    per_tree = [t[["feature", "threshold", "left", "right", "path"]].to_numpy() for _, t in forest.groupby("tree")]
    sampled = int(forest["sampled"].iloc[0])
    expected = 1.0 if sampled == 2 else 2 * (np.log(sampled - 1) + np.euler_gamma) - 2 * (sampled - 1) / sampled
    shared = features.sparkSession.sparkContext.broadcast(per_tree)

    def score(batches):
        for batch in batches:
            x = np.array(batch["features"].tolist(), dtype=float)
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for tree in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    feature = tree[at, 0].astype(int)
                    inner = feature >= 0
                    if not inner.any():
                        break
                    left = x[rows, np.maximum(feature, 0)] <= tree[at, 1]
                    at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)
                total += tree[at, 4]
            batch["raw_score"] = 2.0 ** (-total / len(shared.value) / expected)
            yield batch.drop(columns="features")

    narrow = features.select(*[col(k) for k in key], "features")
    kept = [narrow.schema[k] for k in key]
    return narrow.mapInPandas(score, T.StructType([*kept, T.StructField("raw_score", T.DoubleType())]))


def isolation_scores(df: DataFrame, columns: Sequence[str], key, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Fit and score in one go; the narrow score table is checkpointed, as later steps read it several times."""
    features = prepare_features(df, columns, key)
    return checkpoint(isolation_forest_score(features, isolation_forest_fit(features, key, trees, seed), key))


def detect_anomalies(
    df: DataFrame, columns: Sequence[str], key, contamination: float = 0.05, trees: int = TREES, seed: int = SEED
) -> DataFrame:
    """``key..., raw_score, anomaly_score, is_anomaly``."""
    return scored_labels(isolation_scores(df, columns, key, trees, seed), contamination=contamination)


def anomaly_rate_stability(features: DataFrame, key, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """100 less 500 times the share of rows with a score above one half, not below 0."""
    scores = isolation_forest_score(features, isolation_forest_fit(features, key, trees, seed), key)
    rate = F.avg(F.when(F.col("raw_score") > 0.5, 1.0).otherwise(0.0))
    return scores.agg((100 - F.least(F.lit(100.0), rate * 500)).alias("stability"))
