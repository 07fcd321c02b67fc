from itertools import combinations

from pyspark.sql import functions as F

from tablescope.operators import relations
from catalogue.registry import LABELLED_SQL, query, rounded

PART = ["p_partkey", "p_size", "p_retailprice"]
MIXED = ["p_partkey", "p_size", "p_retailprice", "p_brand"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABELLED = ["n_chars", "quality", "toxic", "lang"]

# price per unit after discount gives a strong pair, the centred size a nonlinear one
DERIVED_SQL = """(SELECT CAST(p_size AS DOUBLE) AS size, CAST((p_size - 25) * (p_size - 25) AS DOUBLE) AS curved,
  p_retailprice AS price, -2 * p_retailprice + p_size AS rebate FROM part)"""
DERIVED = ["size", "curved", "price", "rebate"]


def derived(t):
    return t("part").select(
        F.col("p_size").cast("double").alias("size"),
        ((F.col("p_size") - 25) * (F.col("p_size") - 25)).cast("double").alias("curved"),
        F.col("p_retailprice").alias("price"),
        (-2 * F.col("p_retailprice") + F.col("p_size")).alias("rebate"),
    )


def union(parts):
    return "\nUNION ALL\n".join(parts)


def pearson_sql(table, columns):
    return union(
        f"""SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS pairs,
          CASE WHEN count(*) >= 5 THEN corr({a}, {b}) END AS pearson FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
        for a, b in combinations(columns, 2)
    )


def spearman_sql(table, columns):
    return union(
        f"""SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS pairs, CASE WHEN count(*) >= 5 THEN corr(ra, rb) END AS spearman FROM
          (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb
           FROM (SELECT {a} AS x, {b} AS y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""
        for a, b in combinations(columns, 2)
    )


def bin_sql(c, text):
    if text:
        return f"CAST({c} AS VARCHAR)"
    return f"""CASE WHEN (SELECT count(DISTINCT {c}) FROM s) <= 10 THEN CAST({c} AS VARCHAR) ELSE
      CAST(CAST(greatest(ceil((CAST({c} AS DOUBLE) - (SELECT min({c}) FROM s)) / CAST((SELECT max({c}) - min({c}) FROM s) AS DOUBLE) * 10) - 1, 0) AS BIGINT) AS VARCHAR) END"""


def mi_sql(table, columns, texts, pairs=None):
    return union(
        f"""SELECT * FROM (WITH s AS (SELECT {a} AS x, {b} AS y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
          b AS (SELECT {bin_sql('x', a in texts)} AS bx, {bin_sql('y', b in texts)} AS by_ FROM s),
          j AS (SELECT bx, by_, count(*) * 1.0 / (SELECT count(*) FROM b) AS p FROM b GROUP BY 1, 2),
          px AS (SELECT bx, sum(p) AS p FROM j GROUP BY 1), py AS (SELECT by_, sum(p) AS p FROM j GROUP BY 1)
          SELECT '{a}' AS var1, '{b}' AS var2, (SELECT count(*) FROM b) AS pairs,
            CASE WHEN (SELECT count(*) FROM b) < 10 THEN 0.0 ELSE greatest(0.0, sum(j.p * ln(j.p / (px.p * py.p)))) END AS mutual_info
          FROM j JOIN px ON j.bx = px.bx JOIN py ON j.by_ = py.by_)"""
        for a, b in (pairs or combinations(columns, 2))
    )


@query("pearson_lineitem", f"SELECT var1, var2, pairs, round(pearson, 8) AS pearson FROM ({pearson_sql('lineitem', LINE)})")
def _(t):
    return rounded(relations.pearson_pairs(t("lineitem"), LINE), 8)


@query(
    "pearson_documents",
    f"SELECT var1, var2, pairs, round(pearson, 8) AS pearson FROM ({pearson_sql(LABELLED_SQL, ['doc_id', 'n_chars', 'quality', 'toxic'])})",
)
def _(t):
    return rounded(relations.pearson_pairs(t.labelled_documents()), 8)


@query("spearman_part", f"SELECT var1, var2, pairs, round(spearman, 8) AS spearman FROM ({spearman_sql('part', PART)})")
def _(t):
    return rounded(relations.spearman_pairs(t("part"), PART), 8)


@query(
    "spearman_documents",
    f"SELECT var1, var2, pairs, round(spearman, 8) AS spearman FROM ({spearman_sql(LABELLED_SQL, ['n_chars', 'quality', 'toxic'])})",
)
def _(t):
    return rounded(relations.spearman_pairs(t.labelled_documents(), ["n_chars", "quality", "toxic"]), 8)


@query("spearman_lineitem", f"SELECT var1, var2, pairs, round(spearman, 8) AS spearman FROM ({spearman_sql('lineitem', LINE)})")
def _(t):
    return rounded(relations.spearman_pairs(t("lineitem"), LINE), 8)


@query(
    "bins_part",
    f"""WITH s AS (SELECT p_size AS x, p_retailprice AS y, p_brand AS z FROM part)
    SELECT {bin_sql('x', False)} AS p_size, {bin_sql('y', False)} AS p_retailprice, z AS p_brand FROM s""",
)
def _(t):
    return relations.bin_for_mi(t("part"), ["p_size", "p_retailprice", "p_brand"])


@query(
    "mutual_information_part",
    f"SELECT var1, var2, pairs, round(mutual_info, 8) AS mutual_info FROM ({mi_sql('part', MIXED, ['p_brand'])})",
)
def _(t):
    return rounded(relations.mutual_information(t("part"), MIXED), 8)


@query(
    "mutual_information_documents",
    f"SELECT var1, var2, pairs, round(mutual_info, 8) AS mutual_info FROM ({mi_sql(LABELLED_SQL, LABELLED, ['lang'])})",
)
def _(t):
    return rounded(relations.mutual_information(t.labelled_documents(), LABELLED), 8)


@query(
    "mutual_information_lineitem",
    f"""SELECT var1, var2, pairs, round(mutual_info, 8) AS mutual_info FROM
    ({mi_sql('lineitem', LINE + ['l_returnflag', 'l_linestatus'], ['l_returnflag', 'l_linestatus'])})""",
)
def _(t):
    return rounded(relations.mutual_information(t("lineitem"), LINE + ["l_returnflag", "l_linestatus"]), 8)


@query(
    "self_information_part",
    f"""SELECT var1, var2, pairs, round(mutual_info, 8) AS mutual_info FROM ({mi_sql('part', MIXED, ['p_brand'], [(c, c) for c in MIXED])})""",
)
def _(t):
    return rounded(relations.self_information(t("part"), MIXED), 8)


def mined_sql(table, columns, texts=()):
    numbers = [c for c in columns if c not in texts]
    return f"""(SELECT m.var1, m.var2, p.pearson, s.spearman, m.mutual_info, p.var1 IS NOT NULL AS is_numeric
      FROM ({mi_sql(table, columns, texts)}) m
      LEFT JOIN ({pearson_sql(table, numbers)}) p ON p.var1 = m.var1 AND p.var2 = m.var2
      LEFT JOIN ({spearman_sql(table, numbers)}) s ON s.var1 = m.var1 AND s.var2 = m.var2)"""


MINED = mined_sql(DERIVED_SQL, DERIVED)
MINED_PART = mined_sql("part", MIXED, ["p_brand"])
ROUNDED = "round(pearson, 8) AS pearson, round(spearman, 8) AS spearman, round(mutual_info, 8) AS mutual_info"


@query(
    "correlation_matrix_part",
    f"""WITH m AS {MINED_PART} SELECT var1, var2, {ROUNDED} FROM (SELECT var1, var2, pearson, spearman, mutual_info FROM m
      UNION ALL SELECT var2, var1, pearson, spearman, mutual_info FROM m
      UNION ALL SELECT var1, var2, 1.0, 1.0, mutual_info FROM ({mi_sql('part', MIXED, ['p_brand'], [(c, c) for c in MIXED])}))""",
)
def _(t):
    part = t("part").select(*MIXED)
    matrix = relations.correlation_matrix(relations.mine_relationships(part), relations.self_information(part))
    return rounded(matrix, 8)


@query(
    "correlation_matrix_wide_part",
    f"""WITH m AS (SELECT var1, var2, pearson FROM ({pearson_sql(DERIVED_SQL, DERIVED)}) UNION ALL
        SELECT var2, var1, pearson FROM ({pearson_sql(DERIVED_SQL, DERIVED)}) UNION ALL SELECT x, x, 1.0 FROM (SELECT unnest({DERIVED}) AS x))
      SELECT var1, {", ".join(f"round(max(CASE WHEN var2 = '{c}' THEN pearson END), 8) AS {c}" for c in DERIVED)} FROM m GROUP BY var1""",
)
def _(t):
    table = derived(t)
    pairs = relations.mine_relationships(table, spearman=False)
    matrix = relations.correlation_matrix(pairs, relations.self_information(table))
    return rounded(relations.matrix_wide(matrix, "pearson", DERIVED), 8)


@query(
    "ranked_relationships_part",
    f"""SELECT var1, var2, {ROUNDED}, is_numeric, round(greatest(coalesce(abs(pearson), 0), mutual_info), 8) AS strength,
      CASE WHEN is_numeric THEN 'Numeric-Numeric' ELSE 'Mixed/Categorical' END AS pair_type FROM {MINED_PART}
    ORDER BY greatest(coalesce(abs(pearson), 0), mutual_info) DESC, var1, var2 LIMIT 10""",
)
def _(t):
    return rounded(relations.rank_relationships(relations.mine_relationships(t("part").select(*MIXED))), 8)


CLASSIFIED = f"""(SELECT *, row_number() OVER (PARTITION BY relation ORDER BY CASE WHEN relation = 'nonlinear' THEN mutual_info ELSE abs(pearson) END DESC, var1, var2) AS position
  FROM (SELECT *, CASE WHEN pearson >= 0.5 THEN 'positive' WHEN pearson <= -0.5 THEN 'negative'
    WHEN is_numeric AND mutual_info >= 0.18 AND abs(pearson) < 0.2 THEN 'nonlinear' END AS relation FROM {MINED}) WHERE relation IS NOT NULL)"""


@query(
    "classified_relationships_part",
    f"SELECT var1, var2, {ROUNDED}, is_numeric, relation, CAST(position AS INTEGER) AS position FROM {CLASSIFIED} WHERE position <= 4",
)
def _(t):
    return rounded(relations.classify_relationships(relations.mine_relationships(derived(t)), top=4), 8)


@query(
    "relationship_counts_part",
    f"""SELECT (SELECT count(*) FROM {MINED}) AS scanned, count(*) FILTER (relation = 'positive') AS positive,
      count(*) FILTER (relation = 'negative') AS negative, count(*) FILTER (relation = 'nonlinear') AS nonlinear FROM {CLASSIFIED}""",
)
def _(t):
    return relations.relationship_counts(relations.mine_relationships(derived(t), spearman=False))


@query(
    "strength_labels_part",
    f"""SELECT var1, var2, pairs, round(pearson, 8) AS pearson, CASE WHEN abs(pearson) >= 0.7 THEN 'strong' WHEN abs(pearson) >= 0.4 THEN 'moderate' ELSE 'weak' END
      || CASE WHEN pearson > 0 THEN ' positive' ELSE ' negative' END AS strength_label FROM ({pearson_sql(DERIVED_SQL, DERIVED)})""",
)
def _(t):
    return rounded(relations.label_strength(relations.pearson_pairs(derived(t))), 8)


@query(
    "ols_orders_lineitem",
    """SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS pairs, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
      round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2,
      round(min(l_quantity), 4) AS x_min, round(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * min(l_quantity), 4) AS y_at_min,
      round(max(l_quantity), 4) AS x_max, round(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * max(l_quantity), 4) AS y_at_max
    FROM lineitem""",
)
def _(t):
    return rounded(relations.ols_pair(t("lineitem"), "l_quantity", "l_extendedprice"), 4)


EDGES = f"""(SELECT var1, var2, abs(pearson) AS weight, CASE WHEN pearson > 0 THEN 'positive' ELSE 'negative' END AS sign
  FROM ({pearson_sql(DERIVED_SQL, DERIVED)}) WHERE abs(pearson) >= 0.3)"""


@query("correlation_edges_part", f"SELECT var1, var2, round(weight, 8) AS weight, sign FROM {EDGES}")
def _(t):
    return rounded(relations.correlation_edges(relations.pearson_pairs(derived(t))), 8)


@query(
    "node_degree_part",
    f"""SELECT node, count(e) AS degree FROM (SELECT unnest({DERIVED}) AS node) LEFT JOIN
    (SELECT var1 AS e FROM {EDGES} UNION ALL SELECT var2 FROM {EDGES}) ON e = node GROUP BY node""",
)
def _(t):
    return relations.node_degree(relations.correlation_edges(relations.pearson_pairs(derived(t))), DERIVED)
