from pyspark.sql import functions as F

from tablescope.operators import describe, sketches
from catalogue.registry import query, rounded

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "describe_numeric_lineitem",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
          round(min({c}) + 0.0, 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
          round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem"""
        for c in LINE
    ),
)
def _(t):
    return rounded(describe.describe_numeric(t("lineitem"), LINE))


@query(
    "describe_categorical_part",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM part) AS n, (SELECT count(DISTINCT {c}) FROM part) AS unique_values,
          v AS top, k AS freq FROM (SELECT {c} AS v, count(*) AS k FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""
        for c in ["p_name", "p_brand", "p_type"]
    ),
)
def _(t):
    return describe.describe_categorical(t("part"))


@query("metric_average_lineitem", "SELECT 'Average l_quantity' AS title, round(avg(l_quantity), 6) AS value FROM lineitem")
def _(t):
    return rounded(describe.metric_average(t("lineitem"), "l_quantity"))


@query("metric_sum_orders", "SELECT 'Total o_totalprice' AS title, round(sum(o_totalprice), 2) AS value FROM orders")
def _(t):
    return rounded(describe.metric_sum(t("orders"), "o_totalprice"), 2)


@query("metric_max_orders", "SELECT 'Maximum o_orderpriority' AS title, max(o_orderpriority) AS value FROM orders")
def _(t):
    return describe.metric_max(t("orders"), "o_orderpriority")


@query("metric_min_customer", "SELECT 'Minimum c_acctbal' AS title, min(c_acctbal) AS value FROM customer")
def _(t):
    return describe.metric_min(t("customer"), "c_acctbal")


@query(
    "metric_count_documents",
    "SELECT 'Count of quality' AS title, count(quality) AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(t):
    return describe.metric_count(t.labelled_documents(), "quality")


@query(
    "monthly_trend_orders",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS value
    FROM orders GROUP BY 1""",
)
def _(t):
    return rounded(describe.monthly_trend(t("orders"), "o_orderdate", "o_totalprice"), 2)


@query(
    "category_counts_customer",
    """SELECT c_mktsegment AS label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 6) AS pct
    FROM customer GROUP BY 1""",
)
def _(t):
    return rounded(describe.category_counts(t("customer"), "c_mktsegment"))


@query(
    "filter_preview_events",
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('error') ORDER BY event_id LIMIT 10",
)
def _(t):
    events = t("events").select("event_id", "user_id", "event_type", "value")
    return describe.filter_preview(events, "event_type", ["error"], ["event_id"])


@query(
    "sketched_quartiles_lineitem",
    """SELECT c AS "column", n, low AS min, high AS max, true AS q1_holds, true AS median_holds, true AS q3_holds FROM (
      SELECT 'l_quantity' AS c, count(l_quantity) AS n, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high FROM lineitem
      UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), CAST(min(l_extendedprice) AS DOUBLE), CAST(max(l_extendedprice) AS DOUBLE) FROM lineitem)""",
)
def _(t):
    """Sketches per return flag, merged; each quartile lies within the stated rank error of its exact rank."""
    rows, columns, probs = t("lineitem"), ["l_quantity", "l_extendedprice"], [0.25, 0.5, 0.75]
    merged = sketches.merge_sketches(sketches.quantile_sketches(rows, columns, ["l_returnflag"]))
    found = sketches.quantiles_of(merged, probs)
    values = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = values.join(F.broadcast(found), "column").groupBy("column")  # found: one row per column
    ranks = counts.agg(
        *[F.count(F.when(F.col("value") < F.col(f"q{i}"), 1)).alias(f"below{i}") for i in range(3)],
        *[F.count(F.when(F.col("value") <= F.col(f"q{i}"), 1)).alias(f"upto{i}") for i in range(3)],
    )
    joined = found.join(ranks, "column")
    low = [F.col(f"below{i}") / F.col("n") <= p + sketches.RANK_ERROR for i, p in enumerate(probs)]
    high = [F.col(f"upto{i}") / F.col("n") >= p - sketches.RANK_ERROR for i, p in enumerate(probs)]
    names = ("q1_holds", "median_holds", "q3_holds")
    return joined.select("column", "n", "min", "max", *[(a & b).alias(c) for a, b, c in zip(low, high, names)])
