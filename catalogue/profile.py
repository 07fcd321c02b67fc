from pyspark.sql import functions as F

from tablescope.operators import profile
from catalogue.registry import LABELLED_SQL, query, rounded

LABELLED_TYPES = [
    ("doc_id", "bigint"), ("lang", "string"), ("source", "string"),
    ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int"),
]
ORDER_TYPES = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]


def profile_sql(table, types):
    return "\nUNION ALL\n".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{d}' AS dtype, count({c}) AS non_null,
          count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct,
          count(DISTINCT {c}) AS distinct_values FROM {table}"""
        for i, (c, d) in enumerate(types)
    )


@query("schema_profile_orders", profile_sql("orders", ORDER_TYPES))
def _(t):
    return rounded(profile.schema_profile(t("orders")))


@query("schema_profile_documents", profile_sql(LABELLED_SQL, LABELLED_TYPES))
def _(t):
    return rounded(profile.schema_profile(t.labelled_documents()))


@query(
    "table_stats_events",
    """SELECT n AS n_rows, CAST(6 AS BIGINT) AS n_columns, n * 6 AS total_cells,
      CAST(6 * n - a AS BIGINT) AS missing_cells, round((6 * n - a) * 100.0 / (6 * n), 6) AS missing_pct,
      n - d AS duplicate_rows, CAST(3 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS categorical_columns,
      CAST(1 AS BIGINT) AS datetime_columns, CAST(0 AS BIGINT) AS other_columns
    FROM (SELECT count(*) AS n, count(event_id) + count(ts) + count(user_id) + count(event_type) + count(value)
        + count(props) AS a FROM events), (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM events))""",
)
def _(t):
    return rounded(profile.table_stats(t("events")))


@query(
    "missing_distribution_documents",
    f"""SELECT * FROM (SELECT "column", nulls AS missing_count, round(null_pct, 1) AS missing_pct
      FROM ({profile_sql(LABELLED_SQL, LABELLED_TYPES)})) WHERE missing_count > 0""",
)
def _(t):
    return profile.missing_distribution(t.labelled_documents())


@query(
    "low_cardinality_orders",
    """SELECT unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) AS "column" UNION ALL
    SELECT c FROM (
      SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) AS n FROM orders UNION ALL
      SELECT 'o_orderdate', count(DISTINCT o_orderdate) FROM orders UNION ALL
      SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders) WHERE n < 30""",
)
def _(t):
    orders = t("orders")
    kept = profile.low_cardinality_columns(orders)
    return profile.schema_profile(orders, kept, approx=True).select("column")


@query(
    "date_columns_orders",
    """SELECT CAST(0 AS INTEGER) AS position, 'placed' AS "column", 'string' AS dtype, count(o_orderdate) AS non_null,
      count(*) - count(o_orderdate) AS nulls, 0.0::DOUBLE AS null_pct, count(DISTINCT o_orderdate) AS distinct_values FROM orders""",
)
def _(t):
    orders = t("orders").selectExpr("o_orderkey", "CAST(o_orderdate AS STRING) AS placed", "o_orderstatus")
    return profile.schema_profile(orders, profile.detect_date_columns(orders))


@query(
    "primary_date_events",
    """SELECT 'seen_time' AS date_column, min(ts) AS first_seen, max(ts) AS last_seen FROM events""",
)
def _(t):
    from tablescope.functions.dates import as_timestamp

    events = t("events").selectExpr("event_id", "event_type", "CAST(ts AS STRING) AS seen_time", "value")
    name = profile.primary_date_column(events)
    stamp = as_timestamp(events, name)
    return events.agg(F.min(stamp).alias("first_seen"), F.max(stamp).alias("last_seen")).select(
        F.lit(name).alias("date_column"), "first_seen", "last_seen"
    )
