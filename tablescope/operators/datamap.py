"""Two-dimensional map of prepared features.

The map is the linear projection on the first two principal components.  It is
not a neighbour-embedding layout; the neighbourhood itself is available from
``neighbours.knn_graph``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tablescope.functions.columns import col, require_key
from tablescope.operators.anomalies import ANOMALY
from tablescope.operators.features import sparse_vector


def project_2d(df: DataFrame, columns: Sequence[str], key) -> DataFrame:
    """``key..., map_x, map_y``; each axis points where its largest loading is positive."""
    key = require_key(df, key)
    if df.limit(3).count() < 3:
        raise ValueError("a map needs at least 3 rows")
    found = project_vectors(sparse_vector(df, columns, key), key)
    middle = found.agg(F.avg("map_x").alias("x"), F.avg("map_y").alias("y")).first()  # sparse features are not centred
    return found.withColumns({"map_x": F.col("map_x") - middle["x"], "map_y": F.col("map_y") - middle["y"]})


def project_vectors(vectors: DataFrame, key) -> DataFrame:
    """The projection of an ML vector column ``features``; only the loadings reach the driver."""
    key = require_key(vectors, key)
    width = len(vectors.select("features").first()["features"])
    model = PCA(k=min(2, width), inputCol="features", outputCol="axes").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(loadings.shape[1])]
    axes = vector_to_array("axes")
    second = axes[1] * signs[1] if len(signs) > 1 else F.lit(0.0)
    return model.transform(vectors).select(
        *[col(k) for k in key], (axes[0] * signs[0]).alias("map_x"), second.alias("map_y")
    )


def box_select(df: DataFrame, coordinates: DataFrame, key, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Original rows whose coordinates lie inside the box."""
    key = require_key(df, key)
    inside = coordinates.where(F.col("map_x").between(*x_range) & F.col("map_y").between(*y_range)).select(*key)
    return df.join(inside, key, "left_semi")


def split_overlay(
    df: DataFrame,
    coordinates: DataFrame,
    labels: DataFrame,
    key,
    label: str = "is_anomaly",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Coordinates with a normal/anomalous layer and the columns to show (all by default)."""
    key = require_key(df, key)
    shown = [c for c in columns or df.columns if c not in key]
    layer = F.when(col(label) == ANOMALY, "anomalous").otherwise("normal")
    return (
        coordinates.select(*key, "map_x", "map_y")
        .join(labels.select(*key, layer.alias("layer")), key)
        .join(df.select(*key, *[col(c) for c in shown]), key)
    )
