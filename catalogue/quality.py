from tablescope.operators import quality
from catalogue.registry import LABELLED_SQL, query, rounded


def fences_sql(table: str, columns: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, x
        FROM (SELECT CAST({c} AS DOUBLE) + 0.0 AS x FROM {table} WHERE {c} IS NOT NULL),
             (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {table})"""
        for c in columns
    ]
    union = "\nUNION ALL\n".join(parts)
    return f"""SELECT column_name AS "column", count(*) AS non_null, any_value(q1) AS q1, any_value(q3) AS q3,
      any_value(lo) AS lower_bound, any_value(hi) AS upper_bound,
      CAST(sum(CASE WHEN x < lo OR x > hi THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
      min(x) AS min_value, max(x) AS max_value
    FROM ({union}) GROUP BY column_name"""


def audit_sql(table: str, columns: list[str], where: str = "") -> str:
    return f"""SELECT "column", non_null, round(q1, 4) AS q1, round(q3, 4) AS q3,
      round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound, outliers,
      round(outliers * 100.0 / non_null, 4) AS outlier_pct,
      round(min_value, 4) AS min_value, round(max_value, 4) AS max_value
    FROM ({fences_sql(table, columns)}) {where}"""


EVENT_NUMBERS = ["event_id", "user_id", "value"]
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query("iqr_outliers_events", audit_sql("events", EVENT_NUMBERS, "WHERE outliers > 0"))
def _(t):
    return rounded(quality.iqr_outliers(t("events")), 4)


@query("iqr_audit_lineitem", audit_sql("lineitem", LINE_NUMBERS))
def _(t):
    return rounded(quality.iqr_audit(t("lineitem")), 4)


@query(
    "completeness_documents",
    f"""SELECT missing AS missing_cells, round(missing * 100.0 / (n * 6), 6) AS missing_pct,
      round(100 - missing * 100.0 / (n * 6), 6) AS completeness, missing * 100.0 / (n * 6) > 5 AS alert
    FROM (SELECT count(*) AS n, CAST(6 * count(*) - count(doc_id) - count(lang) - count(source) - count(n_chars)
      - count(quality) - count(toxic) AS BIGINT) AS missing FROM {LABELLED_SQL})""",
)
def _(t):
    return rounded(quality.completeness(t.labelled_documents()))


@query(
    "missing_by_column_documents",
    f"""SELECT * FROM (
      SELECT 'quality' AS "column", count(*) - count(quality) AS missing_count,
        round((count(*) - count(quality)) * 100.0 / count(*), 1) AS missing_pct FROM {LABELLED_SQL}
      UNION ALL
      SELECT 'toxic', count(*) - count(toxic), round((count(*) - count(toxic)) * 100.0 / count(*), 1) FROM {LABELLED_SQL}
    ) WHERE missing_count > 0""",
)
def _(t):
    return quality.missing_by_column(t.labelled_documents())


@query(
    "consistency_orders",
    """SELECT n - d AS duplicate_rows, round((n - d) * 100.0 / n, 6) AS duplicate_pct,
      round(100 - (n - d) * 100.0 / n, 6) AS consistency
    FROM (SELECT count(*) AS n FROM orders),
      (SELECT count(*) AS d FROM (SELECT DISTINCT o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) FROM orders))""",
)
def _(t):
    narrow = t("orders").selectExpr("o_orderstatus", "o_orderpriority", "CAST(o_orderdate AS DATE) AS day")
    return rounded(quality.consistency(narrow))


@query(
    "duplicate_groups_customer",
    """SELECT c_nationkey, c_mktsegment, count(*) AS copies FROM customer
    GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1""",
)
def _(t):
    return quality.duplicate_groups(t("customer").select("c_nationkey", "c_mktsegment"))


HEALTH_EVENTS = fences_sql("events", EVENT_NUMBERS)


@query(
    "outlier_health_events",
    f"""SELECT numeric_cells, outlier_cells, round(outlier_cells * 100.0 / numeric_cells, 6) AS outlier_risk,
      round(100 - outlier_cells * 100.0 / numeric_cells, 6) AS outlier_health
    FROM (SELECT CAST(sum(non_null) AS BIGINT) AS numeric_cells, CAST(sum(outliers) AS BIGINT) AS outlier_cells
      FROM ({HEALTH_EVENTS}))""",
)
def _(t):
    return rounded(quality.outlier_health(t("events")))


LABELLED_FENCES = fences_sql(LABELLED_SQL, ["doc_id", "n_chars", "quality", "toxic"])


@query(
    "health_documents",
    f"""WITH base AS (SELECT count(*) AS n_rows,
        CAST(6 * count(*) - count(doc_id) - count(lang) - count(source) - count(n_chars) - count(quality) - count(toxic)
          AS BIGINT) AS missing_cells FROM {LABELLED_SQL}),
      dup AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM {LABELLED_SQL})),
      outl AS (SELECT CAST(sum(non_null) AS BIGINT) AS cells, CAST(sum(outliers) AS BIGINT) AS outlier_cells FROM ({LABELLED_FENCES})),
      s AS (SELECT n_rows, missing_cells, n_rows - d AS duplicate_rows, outlier_cells,
        round(100 - missing_cells * 100.0 / (n_rows * 6), 1) AS completeness,
        round(100 - (n_rows - d) * 100.0 / n_rows, 1) AS consistency,
        round(100 - outlier_cells * 100.0 / cells, 1) AS outlier_health,
        round(outlier_cells * 100.0 / cells, 1) AS outlier_risk FROM base, dup, outl)
    SELECT *, round(completeness * 0.4 + consistency * 0.3 + outlier_health * 0.3, 1) AS overall,
      CASE WHEN round(completeness * 0.4 + consistency * 0.3 + outlier_health * 0.3, 1) >= 80 THEN 'Excellent'
        WHEN round(completeness * 0.4 + consistency * 0.3 + outlier_health * 0.3, 1) >= 50 THEN 'Fair (Warning)'
        ELSE 'Critical Danger' END AS band FROM s""",
)
def _(t):
    return quality.overall_health(t.labelled_documents())
