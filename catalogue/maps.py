"""Models over whole tables: density clusters, forests, neighbours, two-dimensional maps."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablescope.operators import datamap, dbscan, forest, neighbours
from catalogue.registry import query, rounded


def dbscan_sql(table, key, columns, eps, least):
    """Pairwise neighbours, reachability between core points by recursion, smallest cluster for border points."""
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS x{i}" for i, c in enumerate(columns))
    gap = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(columns)))
    return f"""WITH RECURSIVE p AS MATERIALIZED (SELECT {key} AS k, {scaled} FROM {table}),
      near AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM p a, p b WHERE {gap} <= {eps * eps}),
      core AS MATERIALIZED (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= {least}),
      link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
      reach(k, root) AS (SELECT k, k FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.k WHERE reach.root < link.b),
      home AS (SELECT k, min(root) AS root FROM reach GROUP BY k),
      top AS (SELECT k, root FROM home), named AS (SELECT k, dense_rank() OVER (ORDER BY root) - 1 AS c FROM top),
      border AS (SELECT near.a AS k, min(c) AS c FROM near JOIN named ON named.k = near.b WHERE near.a NOT IN (SELECT k FROM core) GROUP BY near.a),
      labelled AS (SELECT k, c FROM named UNION ALL SELECT k, c FROM border)
    SELECT p.k AS {key}, CASE WHEN c IS NULL THEN 'Outliers/Noise' ELSE 'Cluster ' || c END AS segment FROM p LEFT JOIN labelled ON labelled.k = p.k"""


@query("dbscan_customer", dbscan_sql("customer", "c_custkey", ["c_acctbal", "c_nationkey"], 0.1, 5))
def _(t):
    return dbscan.dbscan_segments(t("customer"), ["c_acctbal", "c_nationkey"], "c_custkey", eps=0.1, min_samples=5)


GROUPED_EVENTS = ["value", "user_id"]


@query("isolation_forest_events")
def _(t):
    return forest.detect_anomalies(t("events"), GROUPED_EVENTS, "event_id", 0.05)


@query(
    "isolation_planted_events",
    "SELECT event_id, CASE WHEN event_id % 40 = 0 THEN 'Anomaly' ELSE 'Normal' END AS is_anomaly FROM events",
)
def _(t):
    """Every fortieth row lies far from the others and from its like."""
    far = F.when(F.col("event_id") % 40 == 0, 100000 + F.col("event_id") % 97 * 10000).otherwise(F.col("value"))
    rows = t("events").select("event_id", far.cast("double").alias("x"))
    share = rows.agg(F.avg(F.when(F.col("event_id") % 40 == 0, 1.0).otherwise(0.0))).first()[0]
    return forest.detect_anomalies(rows, ["x"], "event_id", share).select("event_id", "is_anomaly")


@query("isolation_stability_orders")
def _(t):
    from tablescope.operators.features import prepare_features

    features = prepare_features(t("orders"), ["o_totalprice", "o_custkey"], "o_orderkey")
    return forest.anomaly_rate_stability(features, "o_orderkey")


@query(
    "knn_embeddings",
    """SELECT vec_id, neighbour, round(distance, 6) AS distance, CAST(position AS INTEGER) AS position FROM (
      SELECT a.vec_id, b.vec_id AS neighbour, d.x AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY d.x, b.vec_id) AS position
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id,
      LATERAL (SELECT sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
        lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))) AS x) d) WHERE position <= 15""",
)
def _(t):
    return rounded(neighbours.knn_graph(t("embeddings"), "vec_id", "embedding", k=15))


def embedding_map(t):
    vectors = t("embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    return datamap.project_vectors(vectors, "vec_id")


@query("project_2d_embeddings")
def _(t):
    return embedding_map(t)


@query("project_2d_lineitem")
def _(t):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return datamap.project_2d(t("lineitem"), columns, ["l_orderkey", "l_linenumber"])


@query(
    "project_2d_pair_part",
    """SELECT p_partkey, round((a + b) / sqrt(2), 6) AS map_x, round(abs(a - b) / sqrt(2), 6) AS map_y FROM (SELECT p_partkey,
      (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS b
      FROM (SELECT p_partkey, p_size, p_size * 100 + p_retailprice AS y FROM part))""",
)
def _(t):
    """Two standardised columns that rise together: the axes are their sum and their difference."""
    pair = t("part").select("p_partkey", "p_size", (F.col("p_size") * 100 + F.col("p_retailprice")).alias("y"))
    found = datamap.project_2d(pair, ["p_size", "y"], "p_partkey")
    return rounded(found.select("p_partkey", "map_x", F.abs("map_y").alias("map_y")))


# given coordinates: price and size of a part stand in for the two axes
COORDINATES = "(SELECT p_partkey, p_retailprice AS map_x, CAST(p_size AS DOUBLE) AS map_y FROM part)"


def part_coordinates(t):
    return t("part").select(
        "p_partkey", F.col("p_retailprice").alias("map_x"), F.col("p_size").cast("double").alias("map_y")
    )


@query(
    "box_select_part",
    f"""SELECT * FROM part WHERE p_partkey IN (SELECT p_partkey FROM {COORDINATES} WHERE map_x BETWEEN 950 AND 1200 AND map_y BETWEEN 10 AND 30)""",
)
def _(t):
    return datamap.box_select(t("part"), part_coordinates(t), "p_partkey", (950, 1200), (10, 30))


@query(
    "split_overlay_part",
    f"""SELECT p_partkey, map_x, map_y, CASE WHEN map_x > (SELECT quantile_cont(map_x, 0.95) FROM {COORDINATES}) THEN 'anomalous' ELSE 'normal' END AS layer,
      p_name, p_brand, p_type, p_size, p_retailprice FROM {COORDINATES} JOIN part USING (p_partkey)""",
)
def _(t):
    from tablescope.operators.anomalies import contamination_labels

    labels = contamination_labels(part_coordinates(t), "map_x")
    return datamap.split_overlay(t("part"), part_coordinates(t), labels, "p_partkey")
