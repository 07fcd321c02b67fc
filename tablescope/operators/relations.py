"""Relationship mining between the columns of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablescope.functions.columns import (
    clean,
    col,
    family,
    literal_rows,
    number,
    numeric_columns,
    require_columns,
    require_numeric,
)
from tablescope.functions.labels import strength_label
from tablescope.functions.numbers import clamp, pearson
from tablescope.operators.order_stats import row_ranks
from tablescope.operators.profile import small_cardinalities
from tablescope.session import checkpoint

PAIRS_PER_PASS = 300
LEAST_PAIRS = 5  # fixed value: complete pairs needed for a coefficient
LEAST_MI_ROWS = 10  # fixed value: complete pairs needed for mutual information
BINS = 10  # fixed value: equal-width bins, and the distinct values kept unbinned


def column_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def _chunks(pairs: list, size: int = PAIRS_PER_PASS) -> list[list]:
    return [pairs[i : i + size] for i in range(0, len(pairs), size)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``var1, var2, pairs, pearson`` for all numeric pairs over their complete rows.

    All pairs of a chunk share one aggregate, which shuffles a single row per task.
    """
    columns = require_columns(df, columns or numeric_columns(df), least=2)
    require_numeric(df, *columns)
    frames = []
    for chunk in _chunks(column_pairs(columns)):
        used = [c for c in columns if any(c in p for p in chunk)]
        wide = df.select(*[number(df, c).alias(c) for c in used]).agg(
            *[
                F.struct(
                    F.lit(a).alias("var1"),
                    F.lit(b).alias("var2"),
                    F.count(F.when(col(b).isNotNull(), col(a))).alias("pairs"),
                    pearson(col(a), col(b)).alias("pearson"),
                ).alias(f"p{i}")
                for i, (a, b) in enumerate(chunk)
            ]
        )
        frames.append(wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(chunk))]))))
    enough = F.when(F.col("pairs") >= LEAST_PAIRS, F.col("pearson"))
    return _union(frames).withColumn("pearson", enough)


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``var1, var2, pairs, spearman``: Pearson of average ranks within the complete rows of each pair.

    A pair uses the rows where both columns are present.  If the partner has no
    gaps these are the ranks of the column itself, shared by all such pairs.
    Every row carries its ranks (``row_ranks``), so all pairs of a chunk share one
    aggregate, which shuffles a single row per task.
    """
    columns = require_columns(df, columns or numeric_columns(df), least=2)
    require_numeric(df, *columns)
    names = {c: f"v{i}" for i, c in enumerate(columns)}
    numbers = df.select(*[number(df, c).alias(n) for c, n in names.items()])
    facts = numbers.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in numbers.columns]).first()
    views: dict[str, tuple[str, Column]] = {}

    def given(x: str, y: str) -> Column:
        """The ranks of ``x`` where ``y`` is present."""
        whole = facts[y] == facts["rows"]
        name = f"{x}_rank" if whole else f"{x}_rank_with_{y}"
        views[name] = (x, F.col(x) if whole else F.when(F.col(y).isNotNull(), F.col(x)))
        return F.col(name)

    pairs = column_pairs(columns)
    cells = [
        F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.count(rx + ry).alias("pairs"), pearson(rx, ry).alias("spearman"))
        for a, b in pairs
        for rx, ry in [(given(names[a], names[b]), given(names[b], names[a]))]
    ]
    ranked = row_ranks(numbers, views, facts["rows"]).select(*views)
    if len(cells) > PAIRS_PER_PASS:
        ranked = checkpoint(ranked)
    frames = []
    for chunk in _chunks(cells):
        wide = ranked.agg(*[c.alias(f"p{i}") for i, c in enumerate(chunk)])
        frames.append(wide.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(chunk))]))))
    enough = F.when(F.col("pairs") >= LEAST_PAIRS, F.col("spearman"))
    return _union(frames).withColumn("spearman", enough)


def _restricted(pairs: list[tuple[str, str]], gaps: set[str]):
    """Which restriction of a column each pair needs.

    A pair uses the rows where both columns are present.  If the partner has no
    gaps that is the column itself, shared by all such pairs.  Returns a function
    from (column, partner) to a view name and the columns of the other views.
    """

    def given(x: str, y: str) -> str:
        return x if x == y or y not in gaps else f"{x}_with_{y}"

    sides = [q for p in pairs for q in (p, p[::-1])]
    return given, {given(x, y): F.when(F.col(y).isNotNull(), F.col(x)) for x, y in sides if given(x, y) != x}


def _column_facts(df: DataFrame) -> dict[str, dict]:
    """Gaps of every column; ends and a sketched number of distinct values of the numeric ones.  One scan."""
    numeric = set(numeric_columns(df))
    cells = []
    for i, c in enumerate(df.columns):
        value = number(df, c) if c in numeric else clean(df, c)
        facts = {"gaps": F.count("*") - F.count(value)}
        if c in numeric:
            facts |= {"low": F.min(value), "high": F.max(value), "distinct": F.approx_count_distinct(value)}
        cells.append(F.struct(*[e.alias(name) for name, e in facts.items()]).alias(f"c{i}"))
    found = df.agg(*cells).first()
    return {c: found[i].asDict() for i, c in enumerate(df.columns)}


def _bin_expressions(df: DataFrame, facts: dict[str, dict]) -> dict[str, Column]:
    """Category text of every column: its own values, or one of ten equal-width bins.

    Values are counted exactly only where the sketch does not rule out that they are few.
    """
    numeric = numeric_columns(df)
    near = [c for c in numeric if facts[c]["distinct"] <= 4 * BINS + 20]
    few = small_cardinalities(df, near, BINS, sketched=True)
    out = {c: clean(df, c).cast("string") for c in df.columns}
    for c in numeric:
        if few.get(c) is not None:
            continue
        low, high = facts[c]["low"], facts[c]["high"]
        place = F.ceil((number(df, c) - F.lit(low)) / F.lit(high - low) * BINS) - 1
        out[c] = F.when(place.isNotNull(), F.greatest(place, F.lit(0))).cast("string")
    return out


def bin_for_mi(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns as categories: numeric ones with over ten distinct values in ten equal-width bins."""
    columns = require_columns(df, columns or df.columns)
    picked = df.select(*[col(c) for c in columns])
    bins = _bin_expressions(picked, _column_facts(picked))
    return picked.select(*[bins[c].alias(c) for c in columns])


def mutual_information(
    df: DataFrame, columns: Sequence[str] | None = None, pairs: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """``var1, var2, pairs, mutual_info`` in nats over the complete rows of each pair.

    Bins of a pair come from its complete rows, so a column is binned once more
    for every partner that has missing values.  One scan yields gaps, ends and
    sketched cardinalities, another counts the values of columns that may have few
    (and a third the facts of restricted columns, if there are gaps); then all
    pairs are counted where the rows are read.  The information is
    ln N - (S1 + S2 - S12) / N with S the sum of n ln n, so the marginals are
    never joined back.
    """
    columns = require_columns(df, columns or df.columns)
    pairs = column_pairs(columns) if pairs is None else list(pairs)
    if not pairs:
        raise ValueError("select at least 2 columns")
    used = list(dict.fromkeys(c for p in pairs for c in p))
    names = {c: f"v{i}" for i, c in enumerate(used)}
    base = df.select(*[clean(df, c).alias(n) for c, n in names.items()])
    facts = _column_facts(base)
    gaps = {c for c, f in facts.items() if f["gaps"]}
    frames = []
    for chunk in _chunks(pairs):
        inner = [(names[a], names[b]) for a, b in chunk]
        given, restricted = _restricted(inner, gaps)
        whole = list(dict.fromkeys(c for p in inner for c in p))
        views = base.select(*whole, *[e.alias(name) for name, e in restricted.items()])
        known = facts | (_column_facts(views.select(*restricted)) if restricted else {})
        bins = _bin_expressions(views, known)
        binned = views.select(*[bins[c].alias(c) for c in views.columns])
        cells = [
            F.struct(
                F.lit(i).alias("pair"), F.col(given(x, y)).alias("x"), F.col(given(y, x)).alias("y")
            )
            for i, (x, y) in enumerate(inner)
        ]
        joint = (
            binned.select(F.inline(F.array(*cells)))
            .where("x IS NOT NULL AND y IS NOT NULL")
            .groupBy("pair", "x", "y")
            .agg(F.count("*").alias("n"))
        )
        blank = F.lit(None).cast("string")
        views_of_joint = F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("x").alias("x"), F.col("y").alias("y"), F.col("n").alias("n")),
                F.struct(F.lit(1).alias("side"), F.col("x").alias("x"), blank.alias("y"), F.col("n").alias("n")),
                F.struct(F.lit(2).alias("side"), blank.alias("x"), F.col("y").alias("y"), F.col("n").alias("n")),
            )
        )
        weight = F.col("n") * F.log("n")
        sums = (
            joint.select("pair", views_of_joint)
            .groupBy("pair", "side", "x", "y")
            .agg(F.sum("n").alias("n"))
            .groupBy("pair")
            .agg(
                F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("pairs"),
                F.sum(F.when(F.col("side") == 0, -weight).otherwise(weight)).alias("spread"),
            )
        )
        total = F.col("pairs").cast("double")
        info = F.greatest(F.lit(0.0), F.log(total) - F.col("spread") / total)
        named = literal_rows(
            df.sparkSession, [[F.lit(i), F.lit(a), F.lit(b)] for i, (a, b) in enumerate(chunk)], ["pair", "var1", "var2"]
        )
        frames.append(
            named.join(F.broadcast(sums), "pair", "left").select(
                "var1",
                "var2",
                F.coalesce("pairs", F.lit(0).cast("bigint")).alias("pairs"),
                F.when(F.col("pairs") >= LEAST_MI_ROWS, info).otherwise(F.lit(0.0)).alias("mutual_info"),
            )
        )
    return _union(frames)


def self_information(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Entropy of every column: its mutual information with itself."""
    columns = require_columns(df, columns or df.columns)
    return mutual_information(df, columns, [(c, c) for c in columns])


def mine_relationships(df: DataFrame, columns: Sequence[str] | None = None, spearman: bool = True) -> DataFrame:
    """One row per unordered column pair with all three measures.

    Joins are between tables of one row per column pair.
    """
    columns = require_columns(df, columns or df.columns, least=2)
    numeric = [c for c in columns if family(df.schema[c].dataType) == "numeric"]
    rows = [
        [F.lit(i), F.lit(a), F.lit(b), F.lit(a in numeric and b in numeric)]
        for i, (a, b) in enumerate(column_pairs(columns))
    ]
    out = literal_rows(df.sparkSession, rows, ["pair", "var1", "var2", "is_numeric"])
    on = ["var1", "var2"]
    if len(numeric) > 1:
        out = out.join(F.broadcast(pearson_pairs(df, numeric).drop("pairs")), on, "left")
        if spearman:
            out = out.join(F.broadcast(spearman_pairs(df, numeric).drop("pairs")), on, "left")
    for name in ("pearson", "spearman"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    out = out.join(F.broadcast(mutual_information(df, columns).drop("pairs")), on, "left")
    return out.select("var1", "var2", "pearson", "spearman", "mutual_info", "is_numeric")


def correlation_matrix(relationships: DataFrame, diagonal: DataFrame) -> DataFrame:
    """Long symmetric matrix of all measures; the diagonal holds 1, 1 and the entropy."""
    measures = ["pearson", "spearman", "mutual_info"]
    mirrored = relationships.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), *measures)
    own = diagonal.select("var1", "var2", F.lit(1.0).alias("pearson"), F.lit(1.0).alias("spearman"), "mutual_info")
    return relationships.select("var1", "var2", *measures).unionByName(mirrored).unionByName(own)


def matrix_wide(matrix: DataFrame, measure: str, columns: Sequence[str]) -> DataFrame:
    """One row per column, one output column per partner."""
    return matrix.groupBy("var1").pivot("var2", list(columns)).agg(F.first(measure))


def _strength() -> Column:
    return F.greatest(F.coalesce(F.abs("pearson"), F.lit(0.0)), F.col("mutual_info"))


def rank_relationships(relationships: DataFrame, top: int = 10) -> DataFrame:
    """The strongest pairs by the larger of |r| and mutual information."""
    # a top-k report over one row per column pair
    kind = F.when(F.col("is_numeric"), "Numeric-Numeric").otherwise("Mixed/Categorical")
    return (
        relationships.withColumn("strength", _strength())
        .withColumn("pair_type", kind)
        .orderBy(F.desc("strength"), "var1", "var2")
        .limit(top)
    )


def classify_relationships(relationships: DataFrame, top: int | None = None) -> DataFrame:
    """Pairs that are clearly positive, negative or nonlinear, ranked within their class."""
    r, info = F.col("pearson"), F.col("mutual_info")
    # fixed values: 0.5, -0.5, 0.18 and 0.2
    kind = (
        F.when(r >= 0.5, "positive")
        .when(r <= -0.5, "negative")
        .when(F.col("is_numeric") & (info >= 0.18) & (F.abs(r) < 0.2), "nonlinear")
    )
    size = F.when(F.col("relation") == "nonlinear", info).otherwise(F.abs(r))
    order = Window.partitionBy("relation").orderBy(F.desc(size), "var1", "var2")
    ranked = (
        relationships.withColumn("relation", kind)
        .where("relation IS NOT NULL")
        .withColumn("position", F.row_number().over(order))
    )
    return ranked if top is None else ranked.where(F.col("position") <= top)


def relationship_counts(relationships: DataFrame) -> DataFrame:
    """Scanned pairs and the size of every class."""
    found = classify_relationships(relationships).groupBy("relation").count()

    def count_of(kind: str) -> Column:
        return F.coalesce(found.where(F.col("relation") == kind).select("count").scalar(), F.lit(0).cast("bigint"))

    return relationships.agg(F.count("*").alias("scanned")).select(
        "scanned", *[count_of(k).alias(k) for k in ("positive", "negative", "nonlinear")]
    )


def label_strength(relationships: DataFrame) -> DataFrame:
    return relationships.withColumn("strength_label", strength_label(F.col("pearson")))


def ols_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x``: slope, intercept, R2, end points; no row below 3 pairs."""
    require_numeric(df, x, y)
    rows = df.select(number(df, x).alias("x"), number(df, y).alias("y")).dropna()
    fitted = rows.agg(
        F.count("*").alias("pairs"),
        F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")).alias("slope"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        F.pow(pearson(F.col("x"), F.col("y")), F.lit(2)).alias("r2"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    ).where("pairs >= 3")  # fixed value: 3
    intercept = F.col("mean_y") - F.col("slope") * F.col("mean_x")
    return fitted.select(
        "pairs",
        "slope",
        intercept.alias("intercept"),
        "r2",
        "x_min",
        (intercept + F.col("slope") * F.col("x_min")).alias("y_at_min"),
        "x_max",
        (intercept + F.col("slope") * F.col("x_max")).alias("y_at_max"),
    )


def correlation_edges(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Graph edges: pairs whose |r| reaches the threshold, with weight and sign."""
    return pairs.where(F.abs("pearson") >= threshold).select(
        "var1",
        "var2",
        F.abs("pearson").alias("weight"),
        F.when(F.col("pearson") > 0, "positive").otherwise("negative").alias("sign"),
    )


def node_degree(edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of edges at every column, isolated columns included."""
    nodes = literal_rows(edges.sparkSession, [[F.lit(c)] for c in columns], ["node"])
    ends = edges.select(F.explode(F.array("var1", "var2")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    # one row per column on both sides
    return nodes.join(F.broadcast(ends), "node", "left").select(
        "node", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree")
    )
