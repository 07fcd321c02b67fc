"""Exact k nearest neighbours by a two-level pivot tree, in blocks of bounded size.

There is a pivot for every block of points; the pivots themselves are grouped
around some of them.  A point goes to its closest group and in it to its closest
pivot.  The k smallest pivot distances of the cells around give an upper bound on
the neighbour distance of all points of a cell; a point is sent to another cell
only if the triangle inequality or the bisecting plane leaves room for it within
that bound, first for whole groups, then for the cells of the groups that are
left.  Cells, however full, are split into blocks, and each pair of blocks yields
at most k rows per point.  A pair of blocks is compared by a matrix product; what
rounding could make a neighbour is measured again from differences, so that the
result is exact.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablescope.functions.columns import col, require_columns
from tablescope.session import checkpoint

PIVOT_BYTES = 256 << 20  # of pivots that are broadcast; beyond it cells grow, and are split into more blocks
SLACK = 1e-9  # relative allowance for rounding in the pruning bounds
PAIRS = 1 << 20  # numbers that are compared at a time
BLOCK, LEAST_BLOCK, BLOCKS = 16_384, 2048, 32  # points in a block, smaller only if there are fewer blocks than these
CANDIDATES = 131_072  # points that a block is compared with in one task
BLOCK_BYTES, CANDIDATE_BYTES = 16 << 20, 64 << 20  # of these points, as 64-bit numbers
SAMPLE = 8192  # points that bound the k-th distance, and columns of a product
SENT = 16_384  # rows in a batch
TASKS = 4096  # that the pairs of blocks are dealt to at most


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two sets of points, from differences: equal points are 0 apart."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(out)


class PivotTree:
    """Pivots in groups, with what is known about their cells."""

    def __init__(self, points: np.ndarray):
        pivots = np.unique(points, axis=0)
        self.top = pivots[np.linspace(0, len(pivots) - 1, ceil(len(pivots) ** 0.5)).astype(int)]
        step = max(1, PAIRS // len(self.top))
        group = np.concatenate([_distances(pivots[i : i + step], self.top).argmin(1) for i in range(0, len(pivots), step)])
        order = np.argsort(group, kind="stable")
        self.pivots, self.group = pivots[order], group[order]
        self.first = np.searchsorted(self.group, np.arange(len(self.top) + 1))

    def gaps(self, x: np.ndarray, point: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Distances between points and pivots, pair by pair."""
        out = np.zeros(len(point))
        for j in range(x.shape[1]):
            out += (x[point, j] - self.pivots[cell, j]) ** 2
        return np.sqrt(out)

    def members(self, groups: np.ndarray, most: int = PAIRS):
        """All cells of the groups, as (position in ``groups``, cell), about ``most`` pairs at a time."""
        size = (self.first[1:] - self.first[:-1])[groups]
        total = np.cumsum(size)
        at = 0
        while at < len(groups):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            index = np.repeat(np.arange(at, to), size[at:to])
            inner = np.arange(len(index)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
            yield index, self.first[groups[index]] + inner
            at = to

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each point, the distance to its pivot and the one to its group's."""
        step = max(1, PAIRS // len(self.top))
        parts = [_distances(x[i : i + step], self.top) for i in range(0, len(x), step)]
        group = np.concatenate([p.argmin(1) for p in parts]) if parts else np.zeros(0, int)
        above = np.concatenate([p.min(1) for p in parts]) if parts else np.zeros(0)
        cells, gaps = np.zeros(len(x), int), np.zeros(len(x))
        for index, cell in self.members(group):
            gap = self.gaps(x, index, cell)
            order = np.lexsort([cell, gap, index])
            best = order[np.unique(index[order], return_index=True)[1]]
            cells[index[best]], gaps[index[best]] = cell[best], gap[best]
        return cells, gaps, above

    def measure(self, rows: list, k: int) -> None:
        """Takes sizes, radii and nearest gaps; ``rows`` may lack cells, which are empty then."""
        m = len(self.pivots)
        self.k, self.size, self.radius = k, np.zeros(m), np.zeros(m)
        self.near = np.full((m, k + 1), np.inf)
        self.group_radius, self.group_size = np.zeros(len(self.top)), np.zeros(len(self.top))
        for r in rows:
            c = r["cell"]
            self.size[c], self.radius[c] = r["size"], r["radius"]
            self.near[c, : len(r["near"])] = r["near"]
            g = self.group[c]
            self.group_radius[g] = max(self.group_radius[g], r["above"])
            self.group_size[g] += r["size"]
        self.between_groups = _distances(self.top, self.top)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per cell: a distance within which all its points have k others, and the points of cells within reach.

        The k others are sought in groups, closest first, until there are enough of them.
        """
        bound, candidates = np.zeros(len(cells)), np.zeros(len(cells))
        for i, c in enumerate(cells.tolist()):
            gap = _distances(self.pivots[c : c + 1], self.top)[0]
            order = np.argsort(gap)
            enough = int(np.searchsorted(np.cumsum(self.group_size[order]), self.k + 1)) + 1
            close = np.concatenate([np.arange(self.first[g], self.first[g + 1]) for g in order[:enough]])
            between = _distances(self.pivots[c : c + 1], self.pivots[close])[0]
            reach = (self.radius[c] + between[:, None] + self.near[close]).ravel()
            bound[i] = np.partition(reach, self.k)[self.k] * (1 + SLACK) + SLACK
            left = np.flatnonzero(gap - self.group_radius - self.radius[c] <= bound[i])
            for _, cell in self.members(left):
                between = _distances(self.pivots[c : c + 1], self.pivots[cell])[0]
                candidates[i] += self.size[cell][between - self.radius[c] - self.radius[cell] <= bound[i]].sum()
        return bound, candidates

    def settle(self, rows: list, block: int, others: int | None = None) -> None:
        """Takes the bounds and divides cells into blocks, and their candidates into blocks of ``others``."""
        m = len(self.pivots)
        self.bound, candidates = np.full(m, -np.inf), np.zeros(m)
        for r in rows:
            self.bound[r["cell"]], candidates[r["cell"]] = r["bound"], r["candidates"]
        self.left = np.maximum(1, np.ceil(self.size / block)).astype(int)
        self.right = np.maximum(1, np.ceil(candidates / (others or block))).astype(int)
        self.group_bound = np.maximum.reduceat(self.bound, self.first[:-1])

    def needed(self, x: np.ndarray, home: np.ndarray, own: np.ndarray):
        """(point, cell) for all cells that may hold a neighbour's neighbour: whose points may have the point within their bound."""
        step = max(1, PAIRS // len(self.top))
        for i in range(0, len(x), step):
            part, at = x[i : i + step], self.group[home[i : i + step]]
            gap = _distances(part, self.top)
            nearest = gap[np.arange(len(part)), at][:, None]
            width = self.between_groups[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(width > 0, (gap**2 - nearest**2) / (2 * width), 0.0)
            point, group = np.nonzero((gap - self.group_radius <= self.group_bound) & (plane * (1 - SLACK) <= self.group_bound))
            for index, cell in self.members(group):
                who = point[index]
                far = self.gaps(part, who, cell)
                fits = far - self.radius[cell] <= self.bound[cell]
                who, cell, far = who[fits], cell[fits], far[fits]
                base = home[i + who]
                apart = np.sqrt(((self.pivots[cell] - self.pivots[base]) ** 2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(apart > 0, (far**2 - own[i + who] ** 2) / (2 * apart), 0.0)
                # points of a group are closest to their own pivot among the group's only
                fits = (self.group[base] != self.group[cell]) | (plane * (1 - SLACK) <= self.bound[cell])
                yield i + who[fits], cell[fits]


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column of equally long lists as one array of numbers."""
    if lists.null_count:
        raise ValueError("features must not be null")
    sizes = lists.value_lengths().to_numpy()
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError("features must have the same length in all rows")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def closest(a: np.ndarray, b: np.ndarray, a_id: np.ndarray, b_id: np.ndarray, k: int):
    """``row of a, row of b, distance``: the k nearest of ``b`` with another id, ties by position in ``b``.

    Some points of ``b`` bound the distance of the k-th nearest; a matrix product
    around the middle tells which points can be that near.  Those are measured by
    differences.
    """
    order = np.argsort(b_id, kind="stable")
    low, high = (np.searchsorted(b_id[order], a_id, side) for side in ("left", "right"))  # those with a row's own id
    with np.errstate(over="ignore", invalid="ignore"):
        middle = b.mean(0)
        x, y = a - middle, b - middle
        xx, yy = (x**2).sum(1), (y**2).sum(1)
        # what rounding may add or take, for each row
        slack = (8 + a.shape[1]) * 8 * np.finfo(float).eps * (np.sqrt(xx) + np.sqrt(yy.max())) ** 2
        plain = not np.isfinite(xx.sum() + yy.sum())
    last = min(k, len(b)) - 1
    enough = k - 1 + int((high - low).max())  # so many others are closer than the point of this rank, its own id aside

    def exact(rows: np.ndarray):
        """All of ``b`` measured against some rows."""
        step = max(1, 4 * PAIRS // max(1, b.size))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            gap = np.sqrt(((a[some, None, :] - b[None, :, :]) ** 2).sum(2))
            for r, f, t in zip(range(len(some)), low[some], high[some]):
                gap[r, order[f:t]] = np.inf
            edge = np.partition(gap, last, axis=1)[:, last][:, None]
            closer, level = gap < edge, gap == edge
            room = k - closer.sum(1, keepdims=True)
            r, pick = np.nonzero(closer | (level & (level.cumsum(1) <= room)))
            yield some[r], pick, gap[r, pick]

    if plain:
        yield from exact(np.arange(len(a)))
        return
    turned = np.ascontiguousarray(-2 * y.T)
    some = np.arange(0, len(b), -(-len(b) // SAMPLE))  # bounds the distance of the k-th nearest
    sample, most = np.ascontiguousarray(turned[:, some]), k + len(b) // 8
    step = max(1, PAIRS // SAMPLE)
    for i in range(0, len(a), step):
        rows = np.arange(i, min(i + step, len(a)))
        edge = np.full(len(rows), np.inf)
        if enough < len(some):
            near = x[rows] @ sample + yy[some]
            edge = np.partition(near, enough, axis=1)[:, enough] + 2 * slack[rows]
        found, count = [], np.zeros(len(rows), int)
        for j in range(0, len(b), SAMPLE):
            near = x[rows] @ turned[:, j : j + SAMPLE]
            near += yy[j : j + SAMPLE]
            r, pick = np.divmod(np.flatnonzero(near <= edge[:, None]), near.shape[1])
            found.append((r, pick + j, near[r, pick]))
            count += np.bincount(r, minlength=len(rows))
            edge[count > most] = -np.inf  # too many at nearly the same distance
        if (count > most).any():
            yield from exact(rows[count > most])
        r, pick, near = (np.concatenate(c) for c in zip(*found))
        some_ = (count <= most)[r] & (a_id[rows[r]] != b_id[pick])
        r, pick, near = r[some_], pick[some_], near[some_]
        best = np.lexsort([near, r])
        place = np.arange(len(r)) - np.searchsorted(r[best], r[best])
        edge = np.full(len(rows), np.inf)
        edge[r[best][place == k - 1]] = near[best][place == k - 1]
        fits = near <= (edge + 2 * slack[rows])[r]
        r, pick = r[fits], pick[fits]
        gap, part = np.empty(len(r)), max(1, PAIRS // max(1, a.shape[1]))
        for j in range(0, len(r), part):
            gap[j : j + part] = np.sqrt(((a[rows[r[j : j + part]]] - b[pick[j : j + part]]) ** 2).sum(1))
        best = np.lexsort([pick, gap, r])
        r, pick, gap = r[best], pick[best], gap[best]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        yield rows[r[place < k]], pick[place < k], gap[place < k]


def first_copies(x: np.ndarray, most: int) -> np.ndarray:
    """The rows of ``x`` without those that have ``most`` equal rows before them."""
    bits = np.ascontiguousarray(x).view(np.uint64)
    with np.errstate(over="ignore"):
        code = (bits * (np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))).sum(1)
    order = np.argsort(code, kind="stable")
    place = np.arange(len(x)) - np.searchsorted(code[order], code[order])
    late = order[place >= most]
    first = order[np.searchsorted(code[order], code[late])]
    drop = late[(bits[late] == bits[first]).all(1)]  # rows with one code may still differ
    return np.setdiff1d(np.arange(len(x)), drop, assume_unique=True)


def knn_graph(df: DataFrame, key: str, features: str, k: int = 15, block: int = BLOCK) -> DataFrame:
    """``key, neighbour, distance, position``: the k nearest other rows, ties by key."""
    require_columns(df, [key, features])
    kind, given = df.schema[key].dataType, df.schema[features].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)  # half the bytes
    numbers = T.ArrayType(T.FloatType() if single else T.DoubleType())
    points = df.select(col(key).alias("id"), col(features).cast(numbers).alias("x"))
    facts = points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n = facts["n"]
    if not 1 <= k < n:
        raise ValueError(f"k must lie between 1 and {n - 1}")
    width = 8 * max(1, facts["d"] or 0)
    block = max(1, min(block, max(LEAST_BLOCK, ceil(n / BLOCKS)), BLOCK_BYTES // width))
    others = max(block, min(CANDIDATES, CANDIDATE_BYTES // width))
    wanted = min(ceil(n / block), max(1, PIVOT_BYTES // width))
    tree = PivotTree(np.array([r["x"] for r in points.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()], dtype=float))
    context = df.sparkSession.sparkContext
    shared = context.broadcast(tree)
    base_type = [T.StructField("id", kind), T.StructField("x", numbers)]

    def assign(batches):
        for batch in batches:
            cell, gap, above = shared.value.place(_matrix(batch.column("x")))
            found = [pa.array(cell.astype(np.int32)), pa.array(gap, pa.float64()), pa.array(above, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=["id", "x", "cell", "gap", "above"])

    cell_type = T.StructType(
        [*base_type, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType()), T.StructField("above", T.DoubleType())]
    )
    placed = checkpoint(points.mapInArrow(assign, cell_type))

    # per cell: its size, radius and k + 1 smallest gaps, those of the cell's group beside them
    order = Window.partitionBy("cell").orderBy("gap", "id")
    ranked = placed.select("cell", "gap", "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    nearest = ranked.groupBy("cell").agg(F.array_sort(F.collect_list("gap")).alias("near"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("gap").alias("radius"), F.max("above").alias("above"))
    rows = cells.join(nearest, "cell").collect()  # at most one row per pivot
    tree.measure(rows, k)
    measured = context.broadcast(tree)

    def bounds(batches):
        for batch in batches:
            bound, candidates = measured.value.bounds(batch["cell"].to_numpy())
            yield batch.assign(bound=bound, candidates=candidates)

    spread = df.sparkSession.createDataFrame([(r["cell"],) for r in rows], "cell int").repartition(max(1, len(rows) // 64))
    found = spread.mapInPandas(bounds, "cell int, bound double, candidates double").collect()  # one row per pivot
    tree.settle(found, block, others)
    plan = context.broadcast(tree)

    def hashes(ids: pa.Array) -> np.ndarray:
        return pd.util.hash_pandas_object(ids.to_pandas(), index=False).to_numpy()

    def send(batch, point, cell, left, right):
        """Some rows of a batch for some blocks, not too many at a time."""
        for i in range(0, len(point), SENT):
            some = slice(i, i + SENT)
            parts = [batch.column(c).take(pa.array(point[some])) for c in ("id", "x")]
            parts += [pa.array(v[some].astype(np.int32)) for v in (cell, left, right)]
            yield pa.RecordBatch.from_arrays(parts, names=["id", "x", "cell", "left", "right"])

    def ask(batches):
        """Each point once for every block of candidates of its cell."""
        tree = plan.value
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            own = hashes(batch.column("id")) % tree.left[cell].astype("uint64")
            times = tree.right[cell]
            index = np.repeat(np.arange(len(cell)), times)
            turn = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
            yield from send(batch, index, cell[index], own[index], turn)

    def offer(batches):
        """Each point to every block of the cells that may need it."""
        tree = plan.value
        for batch in batches:
            x, code = _matrix(batch.column("x")), hashes(batch.column("id"))
            for point, cell in tree.needed(x, batch.column("cell").to_numpy(), batch.column("gap").to_numpy()):
                part = (code[point] // np.uint64(7)) % tree.right[cell].astype("uint64")
                times = tree.left[cell]
                index = np.repeat(np.arange(len(point)), times)
                turn = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
                yield from send(batch, point[index], cell[index], turn, part[index])

    block_type = T.StructType([*base_type, *[T.StructField(c, T.IntegerType()) for c in ("cell", "left", "right")]])
    pair_type = T.StructType(
        [T.StructField("id", kind), T.StructField("neighbour", kind), T.StructField("distance", T.DoubleType())]
    )
    id_type = to_arrow_type(kind)

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not len(mine) or not len(theirs):
            return pa.table({"id": pa.array([], id_type), "neighbour": pa.array([], id_type), "distance": pa.array([], pa.float64())})
        theirs = theirs.take(pc.sort_indices(theirs, [("id", "ascending")]))
        a, b = (_matrix(t.column("x").combine_chunks()) for t in (mine, theirs))
        codes, _ = pd.factorize(pd.concat([t.column("id").to_pandas() for t in (mine, theirs)], ignore_index=True), use_na_sentinel=False)
        codes, others = codes[: len(a)], codes[len(a) :]
        # later copies of a point are no nearest: so many of the earlier ones have another id
        some = first_copies(b, k + int(np.bincount(others).max()))
        theirs, b, others = theirs.take(pa.array(some)), b[some], others[some]
        found = [*closest(a, b, codes, others, k)]
        rows, picks, gap = (np.concatenate(c) for c in zip(*found))
        some = np.isfinite(gap)
        ids = [t.column("id").take(pa.array(at[some])) for t, at in ((mine, rows), (theirs, picks))]
        return pa.table([*ids, pa.array(gap[some])], names=["id", "neighbour", "distance"])

    keys = ["cell", "left", "right"]
    tasks = min(TASKS, int((tree.left * tree.right).sum()))  # as many as pairs of blocks, however few their bytes
    asked, offered = (placed.mapInArrow(f, block_type).repartition(tasks, *keys) for f in (ask, offer))
    partial = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(compare, pair_type)
    best = Window.partitionBy("id").orderBy("distance", "neighbour")
    return (
        partial.withColumn("position", F.row_number().over(best))
        .where(F.col("position") <= k)
        .select(F.col("id").alias(key), "neighbour", "distance", "position")
    )
