"""Features, clusters, neighbours, forests and maps against direct computations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescope.operators import anomalies, datamap, dbscan, features, forest, neighbours, segments, silhouettes
from tablescope.operators.graph import connected_components, merged_components
from tablescope.plans import dna


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def test_features(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b", 5.0), (2, None, "a", 5.0), (3, 5.0, None, 5.0), (4, 9.0, "c", 5.0)], "k int, x double, s string, c double"
    )
    hot = features.one_hot(df, ["s", "x", "c"], "k").orderBy("k")
    assert hot.columns == ["k", "x", "c", "s_a", "s_b", "s_c"]  # "Missing" sorts first and is dropped
    assert [r["x"] for r in hot.collect()] == [1.0, 5.0, 5.0, 9.0]
    scaled = features.standardize(df, ["x", "c"], "k").toPandas()
    assert scaled["x"].std(ddof=0) == pytest.approx(1) and (scaled["c"] == 0).all()
    with pytest.raises(ValueError):
        features.one_hot(df.select("k", F.lit("same").alias("s")), ["s"], "k")


def test_sparse_vector_of_many_categories(spark):
    """50,000 categories, one of them held by a third of the rows, against the dense definition."""
    n, k = 90_000, 50_000
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % k).cast("string"))).alias("c"),
        F.when(F.col("id") % 7 > 0, F.lit("even")).alias("d"),
        (F.col("id") % 11).cast("double").alias("x"),
    )
    got = {r["id"]: r["features"] for r in features.sparse_vector(df, ["c", "x", "d"], "id").where("id % 997 = 0").collect()}
    frame = df.toPandas()
    names = sorted(frame["c"].unique())
    count = frame["c"].value_counts()
    x, share = frame["x"], (frame["d"] == "even").mean()
    for key, v in got.items():
        row = frame.iloc[key]
        want = {0: (row["x"] - x.mean()) / x.std(ddof=0)}
        if names.index(row["c"]):
            p = count[row["c"]] / n
            want[names.index(row["c"])] = 1 / np.sqrt(p * (1 - p))
        if row["d"] == "even":  # "Missing" sorts first
            want[len(names)] = 1 / np.sqrt(share * (1 - share))
        assert v.size == len(names) + 1
        assert dict(zip(v.indices.tolist(), v.values.tolist())) == pytest.approx(want)
    assert len(got) == len(range(0, n, 997))
    with pytest.raises(ValueError):
        features.one_hot(df, ["c"], "id")


def test_sparse_and_dense_features_agree(spark):
    """Distances between sparse features are those between the standardised ones."""
    rows = [(i, "abc"[i % 3] if i % 5 else None, float(i * i % 17), "one") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, s string, x double, c string")
    dense = {r["k"]: np.array(r["features"].toArray()) for r in features.feature_vector(df, ["s", "x"], "k").collect()}
    sparse = {r["k"]: np.array(r["features"].toArray()) for r in features.sparse_vector(df, ["s", "x", "c"], "k").collect()}
    shift = dense[0] - sparse[0]
    assert all(np.allclose(dense[k] - sparse[k], shift) for k in dense)
    places = features.category_index(df, ["s", "c"]).orderBy("column", "value").collect()
    assert [(r["column"], r["value"], r["n"], r["place"]) for r in places] == [
        ("c", "one", 40, 0), ("s", "Missing", 8, 0), ("s", "a", 11, 1), ("s", "b", 11, 2), ("s", "c", 10, 3),
    ]
    with pytest.raises(ValueError):
        features.sparse_vector(df, ["c"], "k")


def plain_silhouette(x, labels):
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        means = {c: gap[i, labels == c].sum() / ((labels == c).sum() - (c == own)) for c in set(labels) if (labels == c).sum() > (c == own)}
        a, b = means.pop(own, None), min(v for c, v in means.items() if c != own)
        out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("n, block", [(150, 40), (150, 2048), (9, 2)])
def test_euclidean_silhouette(spark, n, block):
    """Blocks, copies, a label of one row and a label that holds most rows."""
    rng = np.random.default_rng(n)
    labels = np.where(np.arange(n) % 5 > 0, "a", np.where(np.arange(n) % 2, "b", "c")).astype(object)
    labels[0] = "single"
    x = rng.normal(0, 1, (n, 3)) + (labels == "b")[:, None] * 3.0
    x[n // 2 :: 4] = x[1]
    rows = [(i, [float(v) for v in r], str(c)) for i, (r, c) in enumerate(zip(x, labels))]
    df = spark.createDataFrame([*rows, (n, None, "a"), (n + 1, [0.0, 0.0, 0.0], None)], "id long, f array<double>, c string").repartition(5)
    want = plain_silhouette(x, labels)
    assert silhouettes.euclidean_silhouette(df, "f", "c", block).first()[0] == pytest.approx(want, abs=1e-9)
    for cells in (1, 8, 10_000):
        r = silhouettes.silhouette_interval(df, "f", "c", cells).first()
        assert r["low"] - 1e-9 <= want <= r["high"] + 1e-9
    assert r["high"] - r["low"] < 1e-6  # a cell for every point
    one = df.where("c = 'a'")
    assert segments.silhouette(one, "f", "c", "euclidean").first()[0] is None
    assert silhouettes.silhouette_interval(one, "f", "c").first()["low"] is None
    with pytest.raises(ValueError):
        segments.silhouette(df, "f", "c", "other")


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = segments.kmeans_segments(df, ["a", "b"], "id", k=3).toPandas().sort_values("id")
    assert got["segment"].nunique() == 3 and got["segment"].iloc[0] == "Cluster 0"
    assert all(got["segment"].iloc[i * 30 : (i + 1) * 30].nunique() == 1 for i in range(3))
    assert segments.kmeans_segments(df.limit(2), ["a", "b"], "id", k=4).count() == 2


def tile(x, labels, side, blocks=(0, 1)):
    return pa.table(
        {
            "a": pa.array([blocks[0]] * len(x)),
            "b": pa.array([blocks[1]] * len(x)),
            "side": pa.array(side, pa.int32()),
            "row": pa.array(range(len(x)), pa.int64()),
            "x": pa.array(x.tolist(), pa.list_(pa.float64())),
            "label": pa.array(labels),
        }
    )


@pytest.mark.parametrize("strip", [1 << 20, 150])
def test_silhouette_tiles_by_products(monkeypatch, strip):
    """No distance of ordinary points is summed dimension by dimension; those of copies and near points stay exact."""
    rng = np.random.default_rng(strip)
    n = 90
    x, labels, side = 1e6 + rng.normal(0, 1, (n, 5)), rng.choice(list("abc"), n), np.arange(n) % 2
    x[7] = x[8] = x[9] + 1e-7
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    with monkeypatch.context() as m:
        m.setattr(silhouettes, "STRIP", strip)
        m.setattr(silhouettes, "_distances", None)
        found = silhouettes._compare(tile(x, labels, side)).to_pylist()
        within = silhouettes._compare(tile(x, labels, side * 0, (1, 1))).to_pylist()
    assert len(found) == len(within) == 3 * n
    for r in found:
        assert r["total"] == pytest.approx(far[r["row"]][(side != side[r["row"]]) & (labels == r["other"])].sum(), rel=1e-12)
    for r in within:
        assert r["total"] == pytest.approx(far[r["row"]][labels == r["other"]].sum(), rel=1e-12)
    x[3, 2] = 1e200  # its square has no 64-bit number
    gaps = silhouettes.Gaps(x, x[:20]).rows(slice(0, n))
    assert gaps[7, 8] == 0 and np.isinf(gaps[3, 4]) and gaps[5, 6] == pytest.approx(far[5, 6])


def test_silhouettes(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (25, 3)), [[50.0, 50, 50]]])
    label = np.array([0] * 20 + [1] * 25 + [2])
    df = points(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "id long, label int"), "id")

    def direct(gap):
        out = []
        for i in range(len(x)):
            same = (label == label[i]) & (np.arange(len(x)) != i)
            if not same.any():
                out.append(0.0)
                continue
            a = gap[i, same].mean()
            b = min(gap[i, label == c].mean() for c in set(label) - {label[i]})
            out.append((b - a) / max(a, b))
        return np.mean(out)

    squared = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert segments.silhouette(df, "features", "label").first()[0] == pytest.approx(direct(squared), rel=1e-9)
    assert segments.silhouette(df.where("label = 1"), "features", "label").first()[0] is None
    assert segments.silhouette(df.limit(0), "features", "label").first()[0] is None


def test_summary_and_noise(spark):
    df = spark.createDataFrame([("Cluster 0",)] * 5 + [("Cluster 1",)] * 2 + [("Outliers/Noise",)] * 9, "s string")
    got = segments.segment_summary(df, "s").first()
    assert (got["segments"], got["mean_size"], got["noise_rows"], got["noise_pct"]) == (2, 3, 9, 56.25)
    assert segments.largest_segment(df, "s").first()["segment"] == "Cluster 0"


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], number
            while stack:
                for q in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[q] = number
                    stack.append(q)
            number += 1
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        label[i] = around.min() if len(around) else -1
    return ["Outliers/Noise" if v < 0 else f"Cluster {v}" for v in label]


@pytest.mark.parametrize("seed, d, eps, least", [(1, 2, 0.3, 5), (3, 5, 1.2, 5), (5, 1, 0.05, 4)])
def test_dbscan(spark, seed, d, eps, least):
    rng = np.random.default_rng(seed)
    hot = np.repeat(rng.normal(3, 1, (2, d)), 35, axis=0)  # copies of two points hold a third of the rows
    x = np.concatenate([rng.normal(0, 0.3, (90, d)), rng.normal(1.5, 0.5, (40, d)), hot])
    rng.shuffle(x)
    got = dbscan.dbscan_points(points(spark, x), ["id"], eps, least).orderBy("id").collect()
    assert [r["segment"] for r in got] == brute_dbscan(x, eps, least)


def test_dbscan_refines_touching_cells(spark, monkeypatch):
    monkeypatch.setattr(dbscan, "DIRECT_FACTOR", 0)  # settle everything by boxes
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.uniform(0, 1, (60, 2)), rng.uniform(0, 1, (60, 2)) + [1.35, 0]])
    got = dbscan.dbscan_points(points(spark, x), ["id"], 0.4, 4).orderBy("id").collect()
    assert [r["segment"] for r in got] == brute_dbscan(x, 0.4, 4)


def test_components_of_a_long_chain_and_a_star(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    chain = [(i, i + 1) for i in range(10, 29)]
    star = [(59, i) for i in range(40, 59)]
    edges = spark.createDataFrame(chain + star, "left long, right long")
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert got == {i: 10 if 10 <= i < 30 else 40 if i >= 40 else i for i in range(60)}


@pytest.mark.parametrize("task_edges", [1 << 20, 60])
def test_merged_components(spark, task_edges):
    """Chains in order and at random, a star and random edges, in one range or in many."""
    rng = np.random.default_rng(task_edges)
    path = rng.permutation(np.arange(300, 400)).tolist()
    edges = [(i, i + 1) for i in range(10, 90)] + list(zip(path, path[1:])) + [(200, i) for i in range(201, 260)]
    edges += [(int(a), int(b)) for a, b in rng.integers(500, 600, (60, 2))]
    rng.shuffle(edges)
    edges = [tuple(int(x) for x in rng.permutation(e)) for e in edges]
    nodes = spark.range(620).withColumnRenamed("id", "node")
    frame = spark.createDataFrame(edges, "left long, right long").repartition(4)
    want = {i: i for i in range(620)}
    for _ in want:  # the smallest name spreads along the edges until nothing changes
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {r["node"]: r["component"] for r in merged_components(nodes, frame, task_edges).collect()} == want
    if task_edges == 60:
        return
    boxed = frame.select(F.array(F.col("left") % 7, "left").alias("left"), F.array(F.col("right") % 7, "right").alias("right"))
    got = merged_components(nodes.select(F.array(F.col("node") % 7, "node").alias("node")), boxed, task_edges).collect()
    groups, other = {}, {}
    for r in got:
        groups.setdefault(tuple(r["component"]), set()).add(r["node"][1])
    for node, c in want.items():
        other.setdefault(c, set()).add(node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))
    assert all(min([n % 7, n] for n in g) == list(c) for c, g in groups.items())
    assert merged_components(nodes, frame.limit(0)).where("node <> component").count() == 0


@pytest.mark.parametrize("n, d, k, block, hot", [(200, 2, 5, 30, False), (240, 4, 3, 40, True)])
def test_neighbours(spark, n, d, k, block, hot):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(0, 0.3, (n // 2, d)), rng.normal(5, 1, (n - n // 2, d))])
    if hot:
        x[: n // 3] = x[0]
    got = {}
    for r in neighbours.knn_graph(points(spark, x), "id", "features", k, block).collect():
        got.setdefault(r["id"], []).append((round(r["distance"], 9), r["neighbour"]))
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(n):
        assert sorted(got[i]) == sorted((round(gap[i, j], 9), j) for j in range(n) if j != i)[:k]


def test_closest_by_products():
    """Blocks are compared by products; copies, ties by position, own ids and far-off points are exact."""
    rng = np.random.default_rng(3)
    x = np.round(1e5 + rng.normal(0, 1, (300, 3)), 1)  # on a grid: many ties
    x[20:60] = x[20]
    ids = np.arange(300)
    ids[100] = 99
    for points in (x, np.where(np.arange(300)[:, None] == 250, 1e200, x)):
        with np.errstate(over="ignore"):
            gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        gap[ids[:, None] == ids] = np.inf
        got = {}
        for row, pick, far in neighbours.closest(points, points, ids, ids, 7):
            for i, j, g in zip(row.tolist(), pick.tolist(), far.tolist()):
                got.setdefault(i, []).append((g, j))
        for i in range(300):
            if np.isfinite(np.sort(gap[i])[6]):
                assert sorted(got[i]) == sorted((gap[i, j], j) for j in range(300))[:7]


def test_neighbour_blocks_follow_the_rows(spark):
    """A block is compared with many others in one task, so that fewer than k rows for each pair of blocks remain."""
    x = np.random.default_rng(5).normal(0, 1, (400, 24))  # nothing can be left out in so many dimensions
    frame = points(spark, x)
    graph = neighbours.knn_graph(frame, "id", "features", 3, 10)
    plan = graph._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapCoGroupsInPandas" not in plan
    assert graph.count() == 1200


@pytest.mark.parametrize("n, d, block", [(3000, 2, 2), (400, 3, 8), (50, 1, 500)])
def test_pivot_tree(n, d, block):
    """As many pivots as blocks, cells of bounded size, and no lost candidate."""
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(0, 1, (n - n // 4, d)), rng.uniform(-9, 9, (n // 4, d))])
    rng.shuffle(x)
    tree = neighbours.PivotTree(x[: -(-n // block)])
    assert len(tree.pivots) == -(-n // block)
    cell, gap, above = tree.place(x)
    assert np.allclose(gap, np.sqrt(((x - tree.pivots[cell]) ** 2).sum(1)))
    assert np.bincount(cell).max() <= 25 * block  # cells follow the density
    k = 4
    rows = []
    for c in np.unique(cell):
        at = cell == c
        rows.append({"cell": c, "size": at.sum(), "radius": gap[at].max(), "above": above[at].max(), "near": sorted(gap[at])[: k + 1]})
    tree.measure(rows, k)
    names = np.array([r["cell"] for r in rows])
    bound, candidates = tree.bounds(names)
    tree.settle([{"cell": c, "bound": b, "candidates": m} for c, b, m in zip(names, bound, candidates)], block)
    pairs = {(int(p), int(c)) for point, cells in tree.needed(x, cell, gap) for p, c in zip(point, cells)}
    if n == 3000:  # in the plane most cells are out of reach
        assert len(pairs) < n * len(tree.pivots) / 4
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(0, n, 7):
        closest = np.argsort(far[i], kind="stable")[: k + 1]
        assert far[i, closest[-1]] <= tree.bound[cell[i]]
        assert all((int(j), int(cell[i])) in pairs for j in closest)


def test_isolation_forest(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (600, 2)), rng.normal(8, 0.1, (6, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = forest.detect_anomalies(df, ["a", "b"], "id", 0.05).toPandas().set_index("id")
    assert got["raw_score"].between(0, 1, inclusive="neither").all()
    assert (got.loc[600:, "is_anomaly"] == "Anomaly").all()
    assert (got["is_anomaly"] == "Anomaly").mean() == pytest.approx(0.05, abs=0.01)
    assert (got["anomaly_score"].min(), got["anomaly_score"].max()) == (0, 1)
    again = forest.isolation_scores(df.repartition(3), ["a", "b"], "id").toPandas().set_index("id")
    np.testing.assert_allclose(again["raw_score"].sort_index(), got["raw_score"].sort_index())
    with pytest.raises(ValueError):
        forest.detect_anomalies(df.limit(4), ["a", "b"], "id")


def test_large_tables_are_thinned_before_the_draw(spark, monkeypatch):
    monkeypatch.setattr(forest, "SUBSAMPLE", 16)
    table = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("features"))
    drawn = forest._subsamples(table, ["id"], 10, 42).groupBy("tree").count().collect()
    assert len(drawn) == 10 and all(r["count"] == 16 for r in drawn)


def test_scores_and_labels(spark):
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, raw_score double")
    assert [r["anomaly_score"] for r in anomalies.normalize_scores(same).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        anomalies.contamination_labels(same, "raw_score", 0.9)


def test_explanations_use_the_segment(spark):
    rows = [(i, "a" if i < 20 else "b", float(i % 20 if i < 20 else 1000 + i % 20)) for i in range(40)] + [(40, "a", 500.0)]
    df = spark.createDataFrame(rows, "id int, s string, v double")
    hit = df.where("id = 40")
    local = anomalies.explain_anomalies(df, hit, "id", ["v"], "s").collect()
    assert local[0]["direction"] == "higher" and local[0]["group_label"] == "Cluster 'a'"
    assert anomalies.explain_anomalies(df, hit, "id", ["v"]).count() == 0  # unremarkable in the whole table
    noise = hit.withColumn("s", F.lit("Outliers/Noise"))
    assert anomalies.explain_anomalies(df, noise, "id", ["v"], "s").count() == 0


def test_projection(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, 300)
    df = spark.createDataFrame(
        [(i, float(v), float(2 * v + e), float(z)) for i, (v, e, z) in enumerate(zip(base, rng.normal(0, 0.1, 300), rng.normal(0, 1, 300)))],
        "id int, a double, b double, c double",
    )
    got = datamap.project_2d(df, ["a", "b", "c"], "id").toPandas()
    assert got["map_x"].var() > got["map_y"].var()
    with pytest.raises(ValueError):
        datamap.project_2d(df.limit(2), ["a"], "id")


def test_dna(spark):
    df = spark.range(500).select("id", (F.col("id") % 3 * 100 + F.rand(5)).alias("x"), F.lit("k").alias("s"))
    got = dna.dataset_dna(df, "id").first().asDict()
    assert got["quality"] == 100 and all(0 <= v <= 100 for v in got.values())
    tiny = dna.dataset_dna(df.limit(5), "id").first()
    assert (tiny["clusterability"], tiny["stability"]) == (0.0, 100.0)
    # 20,000 rows in three far groups
    wide = spark.range(20000).select("id", (F.when(F.col("id") < 6000, 0).otherwise(F.col("id") % 3) * 1000 + F.rand(5)).alias("x"))
    assert dna.clusterability_score(wide, "id").first()[0] > 90
    a = {r["id"] for r in dna.sample_rows(df, "id", 50).collect()}
    assert a == {r["id"] for r in dna.sample_rows(df.repartition(5), "id", 50).collect()} and len(a) == 50


def test_empty_and_ranked(spark):
    from tablescope.operators.dbscan import dbscan_points

    rows = spark.createDataFrame([], "id long, features array<double>")
    assert dbscan_points(rows, ["id"]).collect() == []
    df = spark.createDataFrame([(i, float(i % 3), float(i % 5)) for i in range(60)] + [(99, 40.0, 400.0)], "id long, a double, b double")
    got = anomalies.explain_anomalies(df, df.where("id = 99"), "id", ["a", "b"]).orderBy("reason_rank").collect()
    assert [r["reason_rank"] for r in got] == [1, 2] and abs(got[0]["z_score"]) >= abs(got[1]["z_score"])
