"""Silhouettes with plain Euclidean distance: exact by tiles of point blocks, or bracketed from cell moments.

The sum of distances from a point to a cluster does not follow from moments, so
the exact mean compares every point with every other one, tile by tile in bounded
memory; its work grows with the square of the rows.  The bracket is linear in the
rows: for a cell of points with mean m and mean squared spread v, the mean
distance from x lies between |x - m| and sqrt(|x - m|^2 + v).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablescope.functions.columns import col, require_columns
from tablescope.session import checkpoint

BLOCK = 32_768  # points in a block at most; a tile holds two blocks
BLOCK_BYTES = 16 << 20  # of the points of a block, as 64-bit numbers
LEAST_BLOCK, BLOCKS = 2048, 16  # smaller blocks than the first are not made to have more than so many
TASKS = 4096  # that tiles are dealt to at most
STRIP = 1 << 20  # distances that are held at a time
NEAR = 1e-6  # closer points, relative to their distances from the middle, are compared by differences
CELLS = 256  # cells whose moments bracket the silhouette, at least one for each label


def _points(df: DataFrame, features: str, label: str) -> DataFrame:
    """``row, x, label``: written once, so that the row numbers hold."""
    require_columns(df, [features, label])
    kind = df.schema[features].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # half the bytes
    x = col(features).cast("array<float>" if single else "array<double>")
    rows = df.select(x.alias("x"), col(label).cast("string").alias("label"))
    rows = rows.where("x IS NOT NULL AND label IS NOT NULL")
    return checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column of equally long lists as one array of numbers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two sets of points; computed from differences, so equal points are 0 apart."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(out)


class Gaps:
    """Distances between two sets of points from one matrix product.

    The product of points taken from their common middle loses digits only where
    two points are much closer to each other than to the middle; those distances
    are taken from differences, and so are all where numbers are missing or huge.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        with np.errstate(over="ignore", invalid="ignore"):
            middle = (a.mean(0) + b.mean(0)) / 2
            self.x, self.y = a - middle, b - middle
            self.xx, self.yy = (self.x**2).sum(1), (self.y**2).sum(1)
            self.plain = not np.isfinite(self.xx.sum() + self.yy.sum())

    def rows(self, some: slice) -> np.ndarray:
        """The distances from some points of ``a`` to all of ``b``."""
        if self.plain:
            return _distances(self.a[some], self.b)
        both = self.xx[some, None] + self.yy
        out = self.x[some] @ (-2 * self.y.T)
        out += both
        both *= NEAR
        i, j = np.nonzero(out <= both)
        if len(i) > out.size // 16:
            return _distances(self.a[some], self.b)
        out[i, j] = ((self.a[some][i] - self.b[j]) ** 2).sum(1)
        return np.sqrt(out, out=out)


def _sums(a: np.ndarray, b: np.ndarray, a_codes: np.ndarray, b_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all points of ``a`` the sum of distances to each label in ``b``, and of those of ``b`` to each label in ``a``.

    Points are sorted by label; every distance is computed once.
    """
    a_first, b_first = (np.flatnonzero(np.append(True, c[1:] != c[:-1])) for c in (a_codes, b_codes))
    gaps, there, back = Gaps(a, b), np.empty((len(a), len(b_first))), np.zeros((len(a_first), len(b)))
    step = max(1, STRIP // len(b))
    for i in range(0, len(a), step):
        strip = gaps.rows(slice(i, i + step))
        there[i : i + step] = np.add.reduceat(strip, b_first, axis=1)
        low, high = np.searchsorted(a_first, [i, i + len(strip)])  # labels that begin in the strip
        starts = a_first[low:high] - i
        if not len(starts) or starts[0] > 0:
            low, starts = low - 1, np.append(0, starts)
        back[low:high] += np.add.reduceat(strip, starts, axis=0)
    return there, back.T


def _compare(table: pa.Table) -> pa.Table:
    """The distance sums of one tile: block ``a`` against block ``b`` and back, or a block against itself."""
    table = table.combine_chunks()
    labels = table.column("label").combine_chunks().dictionary_encode()
    labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
    names, code = labels.dictionary, labels.indices.to_numpy(zero_copy_only=False)
    side, rows = table.column("side").to_numpy(), table.column("row").to_numpy()
    x = _matrix(table.column("x").combine_chunks())
    one, two = ((at := np.flatnonzero(side == s))[np.argsort(code[at], kind="stable")] for s in (0, 1))
    alone = not len(two) and table.column("a")[0] == table.column("b")[0]
    out = []
    if len(one) and (len(two) or alone):
        two = one if alone else two
        there, back = _sums(x[one], x[two], code[one], code[two])
        for mine, theirs, sums in [(one, two, there)] if alone else [(one, two, there), (two, one, back)]:
            used = np.unique(code[theirs])
            out.append((np.repeat(rows[mine], len(used)), np.tile(used, len(mine)), sums.ravel()))
    row, which, total = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0),) * 3
    return pa.table({"row": pa.array(row, pa.int64()), "other": names.take(pa.array(which, pa.int64())), "total": pa.array(total, pa.float64())})


def _mean_silhouette(inside: Column, outside: Column, size: Column) -> Column:
    value = (outside - inside) / F.greatest(inside, outside)
    return F.when(size == 1, 0.0).when(F.greatest(inside, outside) == 0, 0.0).otherwise(value)


def euclidean_silhouette(df: DataFrame, features: str, label: str, block: int = BLOCK) -> DataFrame:
    """One row, ``silhouette``: the mean over all rows with Euclidean distance, exact.

    Points are dealt to blocks of about ``block`` rows at most; every pair of blocks
    is one tile, whose distances are computed once for both directions, and yields
    one sum per point and label.  NULL where there are fewer than two labels; rows without features
    or label do not count; the only row of a label scores 0.
    """
    points = _points(df, features, label)
    counts = points.groupBy("label").agg(F.count("*").alias("size"))
    facts = counts.agg(F.count("*").alias("labels"), F.sum("size").alias("rows")).first()
    if facts["labels"] < 2:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("silhouette"))
    width = max(1, points.agg(F.max(F.size("x"))).first()[0])
    block = max(1, min(block, BLOCK_BYTES // (8 * width)))
    groups = max(-(-facts["rows"] // block), min(BLOCKS, -(-facts["rows"] // LEAST_BLOCK)))
    own = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")
    dealt = points.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.select(
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        *("row", "x", "label"),
    )
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("other", T.StringType()), T.StructField("total", T.DoubleType())]
    )
    dealt = dealt.repartition(min(TASKS, groups * (groups + 1) // 2), "a", "b")  # as many tasks as tiles, however few their bytes
    sums = dealt.groupBy("a", "b").applyInArrow(_compare, schema).groupBy("row", "other").agg(F.sum("total").alias("total"))
    rows = sums.join(points.select("row", "label"), "row").join(
        counts.withColumnRenamed("label", "other"), "other"
    )
    same = F.col("other") == F.col("label")
    scored = rows.groupBy("row").agg(
        F.max(F.when(same, F.col("size"))).alias("size"),
        F.max(F.when(same, F.try_divide(F.col("total"), F.col("size") - 1))).alias("inside"),
        F.min(F.when(~same, F.col("total") / F.col("size"))).alias("outside"),
    )
    return scored.agg(F.avg(_mean_silhouette(F.col("inside"), F.col("outside"), F.col("size"))).alias("silhouette"))


def _cells(points: DataFrame, labels: int, cells: int) -> DataFrame:
    """``label, n, mean, spread`` of the cells: each point goes to the nearest of some points of its own label."""
    each = max(1, cells // labels)
    order = Window.partitionBy("label").orderBy(F.xxhash64("row"), "row")
    some = points.withColumn("r", F.row_number().over(order))
    pivots: dict[str, list] = {}
    for r in some.where(F.col("r") <= each).select("label", "x").collect():  # at most max(cells, labels) points
        pivots.setdefault(r["label"], []).append(r["x"])
    shared = points.sparkSession.sparkContext.broadcast({k: np.array(v, float) for k, v in pivots.items()})

    def place(batches):
        for batch in batches:
            x, names = _matrix(batch.column("x")), np.array(batch.column("label").to_pylist(), object)
            cell = np.zeros(len(names), np.int32)
            for name in set(names):
                at = np.flatnonzero(names == name)
                for i in range(0, len(at), 4096):
                    part = at[i : i + 4096]
                    cell[part] = _distances(x[part], shared.value[name]).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["x", "label", "cell"])

    schema = T.StructType([points.schema["x"], points.schema["label"], T.StructField("cell", T.IntegerType())])
    placed = points.select("x", "label").mapInArrow(place, schema)
    flat = placed.select("label", "cell", F.posexplode("x").alias("k", "v")).groupBy("label", "cell", "k")
    moments = flat.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("spread"))
    both = F.array_sort(F.collect_list(F.struct("k", "mean")))
    return moments.groupBy("label", "cell").agg(
        F.max("n").alias("n"), F.transform(both, lambda s: s["mean"]).alias("mean"), F.sum("spread").alias("spread")
    )


def silhouette_interval(df: DataFrame, features: str, label: str, cells: int = CELLS) -> DataFrame:
    """One row, ``low, high``: bounds that hold the Euclidean silhouette of all rows, at a cost linear in the rows.

    Each label is divided into cells around some of its points (``cells`` in all,
    at least one a label; more give tighter bounds).  A point is compared with the
    moments of the cells only.  NULLs where there are fewer than two labels.
    """
    if cells < 1:
        raise ValueError("cells must be at least 1")
    points = _points(df, features, label)
    counts = {r["label"]: r["n"] for r in points.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a label
    if len(counts) < 2:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("low", "high")])
    found = sorted(_cells(points, len(counts), cells).collect())  # at most max(cells, labels) rows
    names = sorted(counts)
    code = {name: i for i, name in enumerate(names)}
    of = np.array([code[r["label"]] for r in found])
    shared = points.sparkSession.sparkContext.broadcast(
        (
            code,
            np.searchsorted(of, np.arange(len(names))),
            np.array([counts[name] for name in names], float),
            np.array([r["n"] for r in found], float),
            np.array([r["mean"] for r in found], float),
            np.array([r["spread"] for r in found], float),
        )
    )

    def bracket(batches):
        code, starts, size, n, mean, spread = shared.value
        for batch in batches:
            every, names_ = _matrix(batch.column("x")), batch.column("label").to_pylist()
            low, high = [], []
            for i in range(0, len(every), 1024):
                x, own = every[i : i + 1024], np.array([code[v] for v in names_[i : i + 1024]])
                least = _distances(x, mean)
                most = np.sqrt(least**2 + spread)
                lows, highs = (np.add.reduceat(d * n, starts, axis=1) for d in (least, most))
                at = np.arange(len(x))
                others = np.maximum(size[own] - 1, 1)
                inside = lows[at, own] / others, highs[at, own] / others
                lows, highs = lows / size, highs / size
                lows[at, own] = highs[at, own] = np.inf
                outside = lows.min(1), highs.min(1)
                for out, a, b in ((low, inside[1], outside[0]), (high, inside[0], outside[1])):
                    top = np.maximum(a, b)
                    out.append(np.where((size[own] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0)) for c in (low, high)], names=["low", "high"])

    bounds = points.select("x", "label").mapInArrow(bracket, "low double, high double")
    return bounds.agg(F.avg("low").alias("low"), F.avg("high").alias("high"))
