from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablescope.functions.columns import beside
from tablescope.operators import anomalies, features, segments, silhouettes
from catalogue.registry import LABELLED_SQL, query, rounded


@query(
    "epoch_seconds_events",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events",
)
def _(t):
    return features.to_epoch_seconds(t("events").select("event_id", "ts"), ["ts"])


@query(
    "impute_median_documents",
    f"""SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(CAST(quality AS DOUBLE), 0.5) FROM labels)) AS quality,
      coalesce(CAST(toxic AS DOUBLE), (SELECT quantile_cont(CAST(toxic AS DOUBLE), 0.5) FROM labels)) AS toxic FROM {LABELLED_SQL}""",
)
def _(t):
    return features.impute_median(t.labelled_documents().select("doc_id", "quality", "toxic"), ["quality", "toxic"])


@query(
    "impute_missing_label_documents",
    f"SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END, 'Missing') AS grade FROM {LABELLED_SQL}",
)
def _(t):
    graded = t.labelled_documents().select(
        "doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("grade")
    )
    return features.impute_missing_label(graded, ["grade"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


DUMMIES = ", ".join(f'CAST(CAST(o_orderpriority = \'{p}\' AS INTEGER) AS DOUBLE) AS "o_orderpriority_{p}"' for p in PRIORITIES[1:])


@query("one_hot_orders", f"SELECT o_orderkey, o_totalprice, {DUMMIES} FROM orders")
def _(t):
    return features.one_hot(t("orders"), ["o_totalprice", "o_orderpriority"], "o_orderkey")


@query(
    "standardize_customer",
    """SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 8) AS c_acctbal,
      round((c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer), 8) AS c_nationkey FROM customer""",
)
def _(t):
    return rounded(features.standardize(t("customer"), ["c_acctbal", "c_nationkey"], "c_custkey"), 8)


@query(
    "sparse_vector_customer",
    """WITH t AS (SELECT c_custkey, unnest(['c_name', 'c_mktsegment']) AS c, unnest([c_name, c_mktsegment]) AS v FROM customer),
    d AS (SELECT c, v, count(*) * 1.0 / (SELECT count(*) FROM customer) AS p, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS place FROM t GROUP BY 1, 2),
    e AS (SELECT c_custkey, CAST(place + CASE c WHEN 'c_name' THEN 0 ELSE (SELECT count(DISTINCT c_name) - 1 FROM customer) END AS INTEGER) AS slot,
      CAST(round(1 / sqrt(p * (1 - p)), 8) AS DOUBLE) AS value FROM t JOIN d USING (c, v) WHERE place > 0)
    SELECT * FROM e UNION ALL
    SELECT c_custkey, 0, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 8) FROM customer""",
)
def _(t):
    """The entries of sparse features with as many categories as rows."""
    vectors = features.sparse_vector(t("customer"), ["c_acctbal", "c_name", "c_mktsegment"], "c_custkey")
    parts = F.unwrap_udt("features")
    pairs = F.arrays_zip(parts["indices"].alias("slot"), parts["values"].alias("value"))
    rows = vectors.select("c_custkey", F.explode(pairs).alias("e")).select("c_custkey", "e.*").toDF("c_custkey", "slot", "value")
    return rounded(rows, 8)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SCALED = ["c_acctbal", "c_nationkey"] + [f"CAST(c_mktsegment = '{v}' AS INTEGER)" for v in SEGMENTS[1:]]


@query(
    "feature_vector_customer",
    "SELECT c_custkey, "
    + ", ".join(
        f"round(({e} - (SELECT avg({e}) FROM customer)) / (SELECT stddev_pop({e}) FROM customer), 8) AS f{i}"
        for i, e in enumerate(SCALED)
    )
    + " FROM customer",
)
def _(t):
    vectors = features.feature_vector(t("customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"], "c_custkey")
    values = vector_to_array("features")
    return rounded(vectors.select("c_custkey", *[values[i].alias(f"f{i}") for i in range(len(SCALED))]), 8)


@query("kmeans_customer")
def _(t):
    return segments.kmeans_segments(t("customer"), ["c_acctbal", "c_nationkey"], "c_custkey", k=4)


@query(
    "kmeans_bands_customer",
    """SELECT c_custkey, 'Cluster ' || (dense_rank() OVER (ORDER BY first_key) - 1) AS segment
    FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_custkey % 2) AS first_key FROM customer)""",
)
def _(t):
    """Two bands that lie far apart."""
    bands = t("customer").select("c_custkey", (F.col("c_custkey") % 2 * 1000000 + F.col("c_acctbal")).alias("x"))
    return segments.kmeans_segments(bands, ["x"], "c_custkey", k=2)


@query(
    "segment_distribution_customer",
    """SELECT c_mktsegment AS segment, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 2) AS pct
    FROM customer GROUP BY 1""",
)
def _(t):
    return segments.segment_distribution(t("customer"), "c_mktsegment")


@query(
    "segment_summary_customer",
    """SELECT count(*) AS segments, CAST(floor(avg(n)) AS BIGINT) AS mean_size, CAST(0 AS BIGINT) AS noise_rows, 0.0::DOUBLE AS noise_pct
    FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""",
)
def _(t):
    return segments.segment_summary(t("customer"), "c_mktsegment")


@query(
    "largest_segment_orders",
    """SELECT o_orderstatus AS segment, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS pct
    FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def _(t):
    return rounded(segments.largest_segment(t("orders"), "o_orderstatus"))


def long_sql(table, label, columns):
    return "\nUNION ALL\n".join(
        f"""SELECT CAST({label} AS VARCHAR) AS segment, {i} AS position, '{c}' AS feature, avg({c}) AS m,
          (SELECT avg({c}) FROM {table}) AS g, (SELECT stddev_samp({c}) FROM {table}) AS s FROM {table} GROUP BY 1"""
        for i, c in enumerate(columns)
    )


# the third of the price range a part falls in separates the numeric columns
PRICED_SQL = """(SELECT p_partkey, p_size, p_retailprice, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1400 THEN 'middle' ELSE 'high' END AS band FROM part)"""


def priced(t):
    price = F.col("p_retailprice")
    band = F.when(price < 1000, "low").when(price < 1400, "middle").otherwise("high").alias("band")
    return t("part").select("p_partkey", "p_size", "p_retailprice", band)


@query(
    "distinguishing_features_part",
    f"""SELECT segment, CAST(row_number() OVER (PARTITION BY segment ORDER BY abs(round(z, 2)) DESC, position) AS INTEGER) AS feature_rank,
      feature, round(z, 2) AS z_score, round(m, 2) AS segment_mean, round(g, 2) AS global_mean,
      CASE WHEN z > 0 THEN 'higher' ELSE 'lower' END AS direction
    FROM (SELECT *, (m - g) / CASE WHEN s = 0 THEN 1 ELSE s END AS z FROM ({long_sql(PRICED_SQL, 'band', ['p_partkey', 'p_size', 'p_retailprice'])})) WHERE abs(z) >= 0.4""",
)
def _(t):
    return segments.distinguishing_features(priced(t), "band")


@query(
    "segment_mean_comparison_orders",
    f"""SELECT segment, feature, round(m, 6) AS segment_mean, round(g, 6) AS global_mean, round(m - g, 6) AS difference,
      round((m - g) / g * 100, 6) AS difference_pct FROM ({long_sql('orders', 'o_orderstatus', ['o_totalprice', 'o_custkey'])})""",
)
def _(t):
    return rounded(segments.segment_mean_comparison(t("orders"), "o_orderstatus", ["o_totalprice", "o_custkey"]), 6)


@query(
    "attach_labels_documents",
    f"SELECT * FROM {LABELLED_SQL}",
)
def _(t):
    documents = t("documents").select("doc_id", "lang", "source", "n_chars")
    return segments.attach_labels(documents, t("labels"), "doc_id")


PAIR_SQL = """WITH d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg({dist}) FILTER (a.vec_id <> b.vec_id) AS m, count(*) AS k
    FROM embeddings a, embeddings b GROUP BY 1, 2, 3),
  s AS (SELECT vec_id, max(CASE WHEN la = lb THEN m END) AS inside, min(CASE WHEN la <> lb THEN m END) AS outside,
    max(CASE WHEN la = lb THEN k END) AS k FROM d GROUP BY 1)
  SELECT round(avg(CASE WHEN k = 1 THEN 0 ELSE (outside - inside) / greatest(inside, outside) END), 6) AS silhouette FROM s"""
SQUARED = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"


@query("silhouette_embeddings", PAIR_SQL.format(dist=SQUARED))
def _(t):
    vectors = t("embeddings")
    return rounded(segments.silhouette(vectors, "embedding", "label"))


EUCLIDEAN_SQL = PAIR_SQL.format(dist=f"sqrt({SQUARED})")


@query("silhouette_euclidean_embeddings", EUCLIDEAN_SQL)
def _(t):
    return rounded(segments.silhouette(t("embeddings"), "embedding", "label", method="euclidean"))


@query("silhouette_interval_embeddings", f"SELECT true AS holds, true AS narrow, silhouette FROM ({EUCLIDEAN_SQL})")
def _(t):
    """Whether the bounds hold the exact value, and whether they lie within 0.5 of each other."""
    vectors = t("embeddings")
    bounds = silhouettes.silhouette_interval(vectors, "embedding", "label")
    both = beside(bounds, segments.silhouette(vectors, "embedding", "label", method="euclidean"))
    holds = F.col("silhouette").between(F.col("low"), F.col("high"))
    return rounded(both.select(holds.alias("holds"), (F.col("high") - F.col("low") < 0.5).alias("narrow"), "silhouette"))


SCORED_SQL = """(SELECT event_id, user_id, event_type, value, (value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events) AS anomaly_score FROM events)"""
FLAGGED_SQL = f"""(SELECT *, CASE WHEN anomaly_score > (SELECT quantile_cont(anomaly_score, 0.95) FROM {SCORED_SQL}) THEN 'Anomaly' ELSE 'Normal' END AS is_anomaly FROM {SCORED_SQL})"""


def scored(t):
    return anomalies.normalize_scores(t("events").select("event_id", "user_id", "event_type", "value"), "value")


def flagged(t):
    return anomalies.scored_labels(t("events").select("event_id", "user_id", "event_type", "value"), "value")


@query("normalize_scores_events", f"SELECT event_id, user_id, event_type, value, round(anomaly_score, 8) AS anomaly_score FROM {SCORED_SQL}")
def _(t):
    return rounded(scored(t), 8)


@query(
    "contamination_labels_events",
    f"SELECT event_id, round(anomaly_score, 8) AS anomaly_score, is_anomaly FROM {FLAGGED_SQL}",
)
def _(t):
    return rounded(flagged(t).select("event_id", "anomaly_score", "is_anomaly"), 8)


@query(
    "anomaly_summary_events",
    f"""SELECT count(*) FILTER (is_anomaly = 'Anomaly') AS anomalies, round(count(*) FILTER (is_anomaly = 'Anomaly') * 100.0 / count(*), 6) AS anomaly_pct,
      count(*) FILTER (is_anomaly = 'Normal') AS clean_rows, max(anomaly_score) AS max_score FROM {FLAGGED_SQL}""",
)
def _(t):
    return rounded(anomalies.anomaly_summary(flagged(t)))


@query(
    "top_anomalies_events",
    f"""SELECT event_id, value, round(anomaly_score, 8) AS anomaly_score FROM {FLAGGED_SQL} WHERE is_anomaly = 'Anomaly'
    ORDER BY anomaly_score DESC, event_id LIMIT 10""",
)
def _(t):
    return rounded(anomalies.top_anomalies(flagged(t), "event_id").select("event_id", "value", "anomaly_score"), 8)


@query(
    "filter_by_anomaly_events",
    f"SELECT event_id, event_type, value FROM {FLAGGED_SQL} WHERE is_anomaly = 'Normal'",
)
def _(t):
    return anomalies.filter_by_anomaly(flagged(t), "normal").select("event_id", "event_type", "value")


@query(
    "explain_anomalies_events",
    f"""WITH f AS (SELECT * FROM {FLAGGED_SQL}),
      m AS (SELECT event_type, avg(value) AS vm, stddev_samp(value) AS vs, avg(user_id) AS um, stddev_samp(user_id) AS us FROM events GROUP BY 1),
      l AS (SELECT event_id, f.event_type, 'value' AS feature, value AS x, vm AS m, vs AS s FROM f JOIN m USING (event_type) WHERE is_anomaly = 'Anomaly'
        UNION ALL SELECT event_id, f.event_type, 'user_id', user_id, um, us FROM f JOIN m USING (event_type) WHERE is_anomaly = 'Anomaly')
    SELECT event_id, feature, round(x, 2) AS value, round(m, 2) AS group_mean, round((x - m) / s, 2) AS z_score,
      CAST(row_number() OVER (PARTITION BY event_id ORDER BY abs((x - m) / s) DESC, feature) AS INTEGER) AS reason_rank,
      CASE WHEN x > m THEN 'higher' ELSE 'lower' END AS direction, 'Cluster ''' || event_type || '''' AS group_label
    FROM l WHERE abs((x - m) / s) >= 1.5""",
)
def _(t):
    rows = flagged(t)
    hits = anomalies.filter_by_anomaly(rows, "anomalies")
    return anomalies.explain_anomalies(t("events"), hits, "event_id", ["value", "user_id"], segment="event_type")
