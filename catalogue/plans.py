"""Table profiles, findings, summaries and exports."""

import uuid

from pyspark.sql import functions as F

from tablescope.operators import anomalies, features, forest, relations
from tablescope.plans import catalog, dna, findings
from tablescope.sources.csv import read_csv
from tablescope.sources.sinks import write_findings, write_labeled_csv
from catalogue.models import FLAGGED_SQL, flagged
from catalogue.registry import LABELLED_SQL, query, rounded
from catalogue.relations import DERIVED_SQL, MINED, derived

NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def lake(t):
    return {n: t(n) for n in NAMES}


FAMILY_SQL = """CASE WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') THEN 'numeric'
  WHEN data_type IN ('VARCHAR', 'BOOLEAN') THEN 'categorical' WHEN data_type IN ('DATE', 'TIMESTAMP') THEN 'datetime' ELSE 'other' END"""
LAKE_SQL = f"""(SELECT table_name AS t, lower(column_name) AS c, {FAMILY_SQL} AS f FROM information_schema.columns
  WHERE table_name IN ({", ".join(f"'{n}'" for n in NAMES)}))"""
SIZES_SQL = "(" + " UNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS n FROM {n}" for n in NAMES) + ")"


def hits(words):
    return "CAST(sum(CASE WHEN " + " OR ".join(f"contains(c, '{w}')" for w in words) + " THEN 1 ELSE 0 END) AS BIGINT)"


def modules_sql():
    return "CASE base " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in catalog.MODULES.items()) + " END"


@query(
    "column_catalogue_orders_events",
    "\nUNION ALL\n".join(
        f"""SELECT '{n}' AS "table", '{c}' AS "column", '{d}' AS dtype, '{f}' AS family, count(*) AS n_rows, count({c}) AS non_null FROM {n}"""
        for n, columns in {
            "orders": [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"), ("o_orderstatus", "string", "categorical"),
                       ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "categorical")],
            "events": [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "numeric"),
                       ("event_type", "string", "categorical"), ("value", "double", "numeric"), ("props", "string", "categorical")],
        }.items()
        for c, d, f in columns
    ),
)
def _(t):
    return catalog.column_catalogue({n: t(n) for n in ("orders", "events")})


@query(
    "catalog_profile_lake",
    f"""WITH s AS (SELECT t, count(*) AS n_columns, {hits(catalog.CUSTOMER)} AS cu, {hits(catalog.FINANCIAL)} AS fi, {hits(catalog.TRANSACTION)} AS tr,
        bool_or(f = 'datetime') AS dated FROM {LAKE_SQL} GROUP BY t),
      k AS (SELECT *, greatest(cu, fi, tr) AS best FROM s),
      b AS (SELECT *, CASE WHEN best = 0 AND dated THEN 'Time Series Dataset' WHEN best = 0 THEN 'General Tabular Dataset' WHEN tr = best THEN 'Transaction Dataset'
        WHEN fi = best THEN 'Financial Dataset' ELSE 'Customer Dataset' END AS base FROM k),
      m AS (SELECT *, {modules_sql()} AS mods FROM b)
    SELECT m.t AS "table", z.n AS n_rows, n_columns, CASE WHEN dated AND best > 0 THEN 'Temporal ' || base ELSE base END AS dataset_type,
      array_to_string(CASE WHEN dated AND best > 0 THEN list_prepend('Timeline Intelligence', mods)[1:3] ELSE mods[1:3] END, ', ') AS modules
    FROM m JOIN {SIZES_SQL} z ON z.t = m.t""",
)
def _(t):
    return catalog.catalog_profile(lake(t))


@query(
    "catalog_profile_text_dates",
    """SELECT 'placed' AS "table", count(*) AS n_rows, CAST(2 AS BIGINT) AS n_columns, 'Temporal Transaction Dataset' AS dataset_type,
      'Timeline Intelligence, Correlation Discovery, Segment Discovery' AS modules FROM orders
    UNION ALL SELECT 'mixed', count(*), 2, 'Transaction Dataset', 'Correlation Discovery, Segment Discovery, Semantic Data Map' FROM orders
    UNION ALL SELECT 'seen', count(*), 2, 'Time Series Dataset', 'Timeline Intelligence, Future Forecasting, Anomaly Detection' FROM events""",
)
def _(t):
    orders, events = t("orders"), t("events")
    placed = F.col("o_orderdate").cast("string")
    last = orders.agg(F.max("o_orderkey")).scalar()
    return catalog.catalog_profile(
        {
            "placed": orders.select("o_orderkey", placed.alias("placed")),
            # one value that is no date decides
            "mixed": orders.select("o_orderkey", F.when(F.col("o_orderkey") == last, "unknown").otherwise(placed).alias("placed")),
            "seen": events.select(F.col("ts").cast("string").alias("seen"), "value"),
        },
        text_dates=True,
    )


@query(
    "richness_lake",
    f"""SELECT t AS "table", round(least(100, greatest(0, -(a + b + c) / 1.098 * 70 + least(30, n * 1.5))), 1) AS richness FROM (
      SELECT t, count(*) AS n, {", ".join(f"coalesce(nullif(avg(CASE WHEN {w} THEN 1.0 ELSE 0 END), 0) * ln(nullif(avg(CASE WHEN {w} THEN 1.0 ELSE 0 END), 0)), 0) AS {x}"
        for x, w in (('a', "f = 'numeric'"), ('b', "f IN ('categorical', 'other')"), ('c', "f = 'datetime'")))} FROM {LAKE_SQL} GROUP BY t)""",
)
def _(t):
    return catalog.richness_score(catalog.schema_catalogue(lake(t)))


@query(
    "quality_score_documents",
    f"""SELECT greatest(0, round(100 - (least(100, m * 200.0 / (n * 6)) * 0.7 + least(100, (n - d) * 100.0 / n) * 0.3), 1)) AS quality
    FROM (SELECT count(*) AS n, 6 * count(*) - count(doc_id) - count(lang) - count(source) - count(n_chars) - count(quality) - count(toxic) AS m FROM {LABELLED_SQL}),
      (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM {LABELLED_SQL}))""",
)
def _(t):
    return dna.quality_score(t.labelled_documents())


def complexity_sql(table, width, others):
    mean = " + ".join(f"count(DISTINCT {c})" for c in others)
    return f"""SELECT '{table}' AS name, greatest(0, least(100, round(least(100, {width}.0 / greatest(1, count(*) / 1000.0) * 5) * 0.5
      + least(100, ({mean}) * 1.0 / {len(others)} * 2) * 0.5, 1))) AS complexity FROM {table}"""


@query("complexity_score_part", f"SELECT CAST(complexity AS DOUBLE) AS complexity FROM ({complexity_sql('part', 6, ['p_name', 'p_brand', 'p_type'])})")
def _(t):
    return dna.complexity_score(t("part"))


SCORED = {
    "part": (6, ["p_name", "p_brand", "p_type"], False),
    "customer": (5, ["c_name", "c_mktsegment"], False),
    "orders": (6, ["o_orderstatus", "o_orderdate", "o_orderpriority"], True),
    "labels": (3, [], False),
}


@query(
    "recommend_analyses_lake",
    "\nUNION ALL\n".join(
        f"""SELECT name, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS position, title, reason FROM (
          SELECT '{n}' AS name, 1 AS k, 'Timeline Intelligence' AS title, 'the table has a date column' AS reason WHERE {dated} UNION ALL
          SELECT name, 4, 'Correlation Discovery', printf('complexity is %.1f', complexity::DOUBLE) FROM ({complexity_sql(n, w, o) if o else f"SELECT '{n}' AS name, least(100, 3.0 / greatest(1, count(*) / 1000.0) * 5) * 0.5 AS complexity FROM {n}"}) WHERE complexity > 40
          UNION ALL SELECT name, 5, 'Dataset DNA Profile', 'no score stands out' FROM ({complexity_sql(n, w, o) if o else f"SELECT '{n}' AS name, least(100, 3.0 / greatest(1, count(*) / 1000.0) * 5) * 0.5 AS complexity FROM {n}"}) WHERE complexity <= 40 AND NOT {dated})"""
        for n, (w, o, dated) in SCORED.items()
    ),
)
def _(t):
    frames = None
    for name, (_, _, dated) in SCORED.items():
        row = dna.complexity_score(t(name)).select(
            F.lit(name).alias("name"),
            F.lit(dated).alias("has_date"),
            F.lit(None).cast("double").alias("clusterability"),
            F.lit(None).cast("double").alias("stability"),
            "complexity",
        )
        frames = row if frames is None else frames.unionAll(row)
    return findings.recommend_analyses(frames, "name")


#: Scores of three cases from one mean, and the rules they meet.
RULES_SQL = """(WITH s AS (SELECT avg(p_size) AS m FROM part), c AS (
    SELECT 'all' AS name, true AS dated, 2 * m AS a, m AS b, m + 20 AS c FROM s UNION ALL
    SELECT 'none', false, m, 3 * m, m - 10 FROM s UNION ALL SELECT 'two', false, 2 * m, m, NULL FROM s)
  SELECT name, 1 AS k, 'Timeline Intelligence' AS title, 'the table has a date column' AS reason FROM c WHERE dated UNION ALL
  SELECT name, 2, 'Segment Discovery', printf('clusterability is %.1f', a) FROM c WHERE a > 45 UNION ALL
  SELECT name, 3, 'Anomaly Detection', printf('stability is %.1f', b) FROM c WHERE b < 65 UNION ALL
  SELECT name, 4, 'Correlation Discovery', printf('complexity is %.1f', c) FROM c WHERE c > 40)"""


@query(
    "recommend_analyses_scored",
    f"""SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS INTEGER) AS position, title, reason FROM {RULES_SQL}
    UNION ALL SELECT name, 0, 'Dataset DNA Profile', 'no score stands out' FROM (VALUES ('all'), ('none'), ('two')) AS v(name)
      WHERE name NOT IN (SELECT name FROM {RULES_SQL})""",
)
def _(t):
    m = t("part").agg(F.avg("p_size").alias("m"))
    row = lambda name, dated, a, b, c: m.select(
        F.lit(name).alias("name"), F.lit(dated).alias("has_date"), a.alias("clusterability"), b.alias("stability"), c.alias("complexity")
    )
    m_ = F.col("m")
    rows = row("all", True, m_ * 2, m_, m_ + 20)
    rows = rows.unionAll(row("none", False, m_, m_ * 3, m_ - 10))
    rows = rows.unionAll(row("two", False, m_ * 2, m_, F.lit(None).cast("double")))
    return findings.recommend_analyses(rows, "name")


@query("clusterability_part")
def _(t):
    return dna.clusterability_score(t("part"), "p_partkey")


@query("dataset_dna_orders")
def _(t):
    return dna.dataset_dna(t("orders"), "o_orderkey")


@query("sample_rows_orders")
def _(t):
    return dna.sample_rows(t("orders"), "o_orderkey", 5000)


@query(
    "sample_rows_digest_orders",
    """SELECT * FROM (SELECT o_orderkey, o_totalprice, md5(CAST(o_orderkey AS VARCHAR) || ':42') AS digest FROM orders)
    ORDER BY digest, o_orderkey LIMIT 5000""",
)
def _(t):
    digest = F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42")).cast("binary")).alias("digest")
    return dna.sample_rows(t("orders").select("o_orderkey", "o_totalprice", digest), "o_orderkey", 5000, by="digest")


#: Three groups by the key in three columns, and a fourth column that has nothing to do with them.
GROUPED_SQL = """(SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 3 AS g, (p_partkey % 3) * 10.0 + (p_partkey * 7 % 11) / 11.0 AS a,
  (p_partkey % 3) * 10.0 + (p_partkey * 5 % 13) / 13.0 AS b, (p_partkey % 3) * 10.0 + (p_partkey * 2 % 7) / 7.0 AS d, (p_partkey * 7919 % 101) * 1.0 AS c FROM part)"""


@query(
    "clusterability_grouped_part",
    f"""WITH z AS (SELECT k, g, unnest(['a', 'b', 'c', 'd']) AS f, unnest([(a - avg(a) OVER ()) / stddev_pop(a) OVER (),
      (b - avg(b) OVER ()) / stddev_pop(b) OVER (), (c - avg(c) OVER ()) / stddev_pop(c) OVER (), (d - avg(d) OVER ()) / stddev_pop(d) OVER ()]) AS v FROM {GROUPED_SQL}),
    m AS (SELECT g, f, avg(v) AS mean, var_pop(v) AS spread, count(*) AS n FROM z GROUP BY 1, 2),
    d AS (SELECT k, z.g AS own, m.g AS other, sum((v - mean) * (v - mean) + spread) AS far, max(n) AS n FROM z JOIN m ON z.f = m.f GROUP BY 1, 2, 3),
    s AS (SELECT k, max(CASE WHEN own = other THEN far * n / (n - 1) END) AS x, min(CASE WHEN own <> other THEN far END) AS y FROM d GROUP BY 1)
    SELECT round(least(100, greatest(0, (avg((y - x) / greatest(x, y)) + 0.1) * 125)), 1) AS clusterability FROM s""",
)
def _(t):
    number_ = F.col("p_partkey")
    rows = t("part").select(
        number_.cast("string").alias("k"),
        (number_ % 3 * 10.0 + number_ * 7 % 11 / 11.0).alias("a"),
        (number_ % 3 * 10.0 + number_ * 5 % 13 / 13.0).alias("b"),
        (number_ % 3 * 10.0 + number_ * 2 % 7 / 7.0).alias("d"),
        (number_ * 7919 % 101 * 1.0).alias("c"),
    )
    return dna.clusterability_score(rows, "k")


def far_rows(t):
    """Most rows hold one number, every 50th a large one and the next a small one: these are the isolated rows."""
    place = F.col("o_orderkey") % 50
    x = F.when(place == 0, 100.0).when(place == 1, -100.0).otherwise(0.0)
    return t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("k"), x.alias("x"), "o_orderstatus")


STABILITY_SQL = "greatest(0, 100 - least(100, avg(CASE WHEN o_orderkey % 50 < 2 THEN 1.0 ELSE 0 END) * 500))"


@query("isolation_stability_far_orders", f"SELECT CAST(round({STABILITY_SQL}, 8) AS DOUBLE) AS stability FROM orders")
def _(t):
    return rounded(forest.anomaly_rate_stability(features.prepare_features(far_rows(t), ["x"], "k"), "k"), 8)


@query("stability_far_orders", f"SELECT CAST(round({STABILITY_SQL}, 1) AS DOUBLE) AS stability FROM orders")
def _(t):
    return dna.stability_score(far_rows(t), "k")


@query(
    "dataset_dna_far_orders",
    f"""SELECT *, round((quality + complexity + clusterability + stability + richness) / 5, 1) AS overall FROM (
      SELECT 100.0::DOUBLE AS quality, 100.0::DOUBLE AS clusterability, CAST(round({STABILITY_SQL}, 1) AS DOUBLE) AS stability,
        CAST(round(least(100, 3 / greatest(1, count(*) / 1000.0) * 5) * 0.5
          + least(100, (count(*) + count(DISTINCT o_orderstatus)) / 2.0 * 2) * 0.5, 1) AS DOUBLE) AS complexity,
        round(-(ln(1 / 3.0) / 3 + ln(2 / 3.0) * 2 / 3) / 1.098 * 100 * 0.7 + 4.5, 1)::DOUBLE AS richness FROM orders)""",
)
def _(t):
    """Three tight groups of which two are rare and far off: a silhouette of 1, and the rare rows isolated."""
    return dna.dataset_dna(far_rows(t), "k")


TOP_POSITIVE = f"(SELECT * FROM {MINED} WHERE pearson >= 0.5 ORDER BY greatest(abs(pearson), mutual_info) DESC, var1, var2 LIMIT 1)"
TOP_NEGATIVE = f"(SELECT * FROM {MINED} WHERE pearson <= -0.5 ORDER BY pearson, var1, var2 LIMIT 1)"


@query(
    "findings_documents",
    f"""SELECT CAST(1 AS INTEGER) AS position, 'missing_values' AS rule, 'warning' AS severity, 'dataset' AS subject, round(p, 6) AS value,
      printf('%.1f%% of all cells are empty; fill them or leave out the columns concerned.', p) AS text
      FROM (SELECT (2 * count(*) - count(quality) - count(toxic)) * 100.0 / (count(*) * 5) AS p FROM {LABELLED_SQL}) WHERE p > 5
    UNION ALL SELECT 2, 'dominant_segment', 'info', lang, round(p, 6), printf('Largest segment: %s, %.1f%% of the rows.', lang, p)
      FROM (SELECT lang, count(*) * 100.0 / (SELECT count(*) FROM documents) AS p FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""",
)
def _(t):
    return rounded(findings.generate_findings(t.labelled_documents(), segment="lang"))


@query(
    "findings_part",
    f"""SELECT CAST(1 AS INTEGER) AS position, 'complete' AS rule, 'good' AS severity, 'dataset' AS subject, 0.0::DOUBLE AS value,
      'No cell is empty.' AS text
    UNION ALL SELECT 4, 'positive_pair', 'good', var1 || ' / ' || var2, round(pearson, 6),
      printf('%s and %s rise together (r = %.2f).', var1, var2, pearson) FROM {TOP_POSITIVE}
    UNION ALL SELECT 5, 'negative_pair', 'alert', var1 || ' / ' || var2, round(pearson, 6),
      printf('%s and %s move in opposite directions (r = %.2f).', var1, var2, pearson) FROM {TOP_NEGATIVE}""",
)
def _(t):
    table = derived(t)
    return rounded(findings.generate_findings(table, relationships=relations.mine_relationships(table, spearman=False)))


@query(
    "executive_summary_events",
    f"""WITH f AS {FLAGGED_SQL}, s AS (SELECT event_type, count(*) * 100.0 / (SELECT count(*) FROM events) AS p FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT * FROM (SELECT CAST(1 AS INTEGER) AS position, 'Dataset' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM events
    UNION ALL SELECT 2, 'Dataset', 'features', 3, NULL
    UNION ALL SELECT 3, 'Dataset', 'missing_pct', 0, NULL
    UNION ALL SELECT 4, 'Dataset', 'duplicate_rows', (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT event_id, user_id, value FROM events)), NULL
    UNION ALL SELECT 5, 'Anomalies', 'anomalies', count(*) FILTER (is_anomaly = 'Anomaly'), NULL FROM f
    UNION ALL SELECT 6, 'Anomalies', 'max_score', max(anomaly_score), NULL FROM f
    UNION ALL SELECT 7, 'Segments', 'segments', count(DISTINCT event_type), NULL FROM events
    UNION ALL SELECT 8, 'Segments', 'largest_segment', round(p, 6), event_type FROM s)""",
)
def _(t):
    return rounded(
        findings.executive_summary(flagged(t), segment="event_type", anomaly="is_anomaly", score="anomaly_score")
    )


@query("report_rows_orders")
def _(t):
    orders = anomalies.scored_labels(t("orders"), "o_totalprice")
    numbers = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return findings.report_rows(
        orders,
        dna=dna.dataset_dna(t("orders"), "o_orderkey"),
        segment="o_orderstatus",
        anomaly="is_anomaly",
        score="anomaly_score",
        relationships=relations.mine_relationships(numbers, spearman=False),
    )


@query(
    "report_rows_part",
    f"""SELECT CAST(1 AS INTEGER) AS position, 'Dataset' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM part
    UNION ALL SELECT 2, 'Dataset', 'features', 4, NULL
    UNION ALL SELECT 3, 'Dataset', 'missing_pct', 0, NULL
    UNION ALL SELECT 4, 'Dataset', 'duplicate_rows', (SELECT count(*) FROM part) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {DERIVED_SQL})), NULL
    UNION ALL SELECT 30, 'Correlations', 'pair', round(pearson, 6), printf('%s with %s: %s, %s (r = %.2f)', var1, var2,
      CASE WHEN abs(pearson) > 0.7 THEN 'strong' WHEN abs(pearson) > 0.4 THEN 'moderate' ELSE 'weak' END,
      CASE WHEN pearson > 0 THEN 'rising' ELSE 'falling' END, pearson)
      FROM (SELECT * FROM {MINED} ORDER BY greatest(abs(pearson), mutual_info) DESC, var1, var2 LIMIT 5)""",
)
def _(t):
    """The sections without model scores."""
    table = derived(t)
    return rounded(findings.report_rows(table, relationships=relations.mine_relationships(table, spearman=False)))


def _folder(t, name):
    """A fresh folder beside the checkpoints, on the storage all executors share."""
    from tablescope.session import shared_folder

    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "labelled_csv_events",
    f"""SELECT CAST(event_id AS INTEGER) AS event_id, CAST(user_id AS INTEGER) AS user_id, event_type, value, props,
      round(anomaly_score, 8) AS anomaly_score, is_anomaly FROM {FLAGGED_SQL} JOIN (SELECT event_id, props FROM events) USING (event_id)""",
)
def _(t):
    path = _folder(t, "labelled-csv")
    labels = flagged(t).select("event_id", "anomaly_score", "is_anomaly")
    write_labeled_csv(t("events").drop("ts"), labels, "event_id", path)
    return rounded(read_csv(t.spark, path), 8)


@query(
    "csv_documents",
    "SELECT CAST(doc_id AS INTEGER) AS doc_id, text, lang FROM documents",
)
def _(t):
    path = _folder(t, "csv")
    documents = t("documents").select("doc_id", "text", "lang")
    write_labeled_csv(documents.select("doc_id", "text"), documents.select("doc_id", "lang"), "doc_id", path)
    return read_csv(t.spark, path)


@query(
    "written_findings_events",
    f"""SELECT CAST(1 AS INTEGER) AS position, 'complete' AS rule, 'good' AS severity, 'dataset' AS subject, 0.0::DOUBLE AS value,
      'No cell is empty.' AS text
    UNION ALL SELECT 3, 'anomalies', 'alert', 'rows', n, printf('%d rows carry the anomaly label.', n)
      FROM (SELECT count(*) AS n FROM {FLAGGED_SQL} WHERE is_anomaly = 'Anomaly')""",
)
def _(t):
    path = _folder(t, "findings")
    write_findings(findings.generate_findings(flagged(t), anomaly="is_anomaly"), path)
    return t.spark.read.parquet(path)
