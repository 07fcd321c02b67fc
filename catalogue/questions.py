"""Questions derived from every event row and from whole conversation turns."""

import re

from pyspark.sql import functions as F

from tablescope.plans import questions as q
from catalogue.registry import query, rounded

# the same expression in both engines turns an event into an English question about lineitem
QUESTION = """concat(
  CASE event_type WHEN 'click' THEN 'What is the average ' WHEN 'view' THEN 'Show the total ' WHEN 'purchase' THEN 'Give me the highest '
    WHEN 'signup' THEN 'How many ' WHEN 'error' THEN 'List the top outliers of ' ELSE 'Discount ' END,
  CASE WHEN value < 2 THEN 'l_quantity' WHEN value < 5 THEN 'l discount' WHEN value < 10 THEN 'revenue' WHEN value < 20 THEN 'return flags'
    WHEN value < 40 THEN 'shipdate' WHEN value < 80 THEN 'weather trend' ELSE 'group segments' END)"""
ASKED = f"(SELECT event_id, {QUESTION} AS question FROM events)"


def asked(t):
    return t("events").selectExpr("event_id", f"{QUESTION} AS question")


def word_sql(words, text):
    pattern = r"\b(?:" + "|".join(re.escape(w).replace("\\ ", " ") for w in words) + r")\b"
    return f"regexp_matches(lower({text}), '{pattern}')"


def part_sql(words, text):
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


def intent_sql(text, test=word_sql):
    cases = " ".join(f"WHEN {test(w, text)} THEN '{n}'" for n, w in q.INTENTS.items())
    return f"CASE {cases} ELSE 'unknown' END"


def subtype_sql(text, intent, test=word_sql):
    out = []
    for name, kinds in q.SUBTYPES.items():
        same = f"{intent} IN ('segment', 'cluster')" if name == "segment" else f"{intent} = '{name}'"
        inner = " ".join(f"WHEN {test(w, text)} THEN '{k}'" for k, w in kinds.items())
        out.append(f"WHEN {same} THEN CASE {inner} ELSE 'general' END")
    return f"CASE {' '.join(out)} END"


LINE = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def column_sql(text):
    cases = [f"WHEN contains(lower({text}), '{c.replace('_', ' ')}') OR contains(lower({text}), '{c}') THEN '{c}'" for c in LINE]
    # of the business words, revenue finds the price, sales the price; profit finds nothing in lineitem
    cases += [f"WHEN {word_sql(['revenue'], text)} THEN 'l_extendedprice'", f"WHEN {word_sql(['sales'], text)} THEN 'l_extendedprice'"]
    cases += [f"WHEN {word_sql([w], text)} THEN '{c}'" for c in LINE for w in c.split("_") if len(w) > 2]
    return f"CASE {' '.join(cases)} END"


TAGGED = f"""(SELECT *, {subtype_sql('question', 'intent')} AS subtype,
  CASE WHEN intent NOT IN ('correlation', 'anomaly') THEN {column_sql('question')} END AS matched_column
  FROM (SELECT *, {intent_sql('question')} AS intent FROM {ASKED}))"""


@query("intents_events", f"SELECT event_id, question, intent FROM {TAGGED}")
def _(t):
    return asked(t).withColumn("intent", q.tag_intent(F.col("question")))


@query(
    "intents_conversations",
    f"SELECT conv_id, turn, {intent_sql('text')} AS intent, {intent_sql('text', part_sql)} AS loose_intent FROM conversations WHERE role = 'user'",
)
def _(t):
    turns = t("conversations").where("role = 'user'")
    return turns.select(
        "conv_id", "turn", q.tag_intent(F.col("text")).alias("intent"), q.tag_intent(F.col("text"), parity=True).alias("loose_intent")
    )


@query("matched_columns_events", f"SELECT event_id, intent, subtype, matched_column FROM {TAGGED}")
def _(t):
    return q.tag_questions(asked(t), "question", t("lineitem").columns).drop("question")


NUMERIC = LINE[:8]


def metrics_sql():
    rows = []
    for c in LINE:
        rows.append(f"SELECT '{c}' AS c, 'count' AS i, CAST(count({c}) AS DOUBLE) AS v, NULL AS w FROM lineitem")
        for name, f in (("maximum", "max"), ("minimum", "min")):
            if c in NUMERIC:
                rows.append(f"SELECT '{c}', '{name}', CAST({f}({c}) AS DOUBLE), NULL FROM lineitem")
            elif c != "l_shipdate":
                rows.append(f"SELECT '{c}', '{name}', NULL, {f}({c}) FROM lineitem")
            else:
                rows.append(f"SELECT '{c}', '{name}', NULL, strftime({f}({c}), '%Y-%m-%d %H:%M:%S') FROM lineitem")
        if c in NUMERIC:
            rows += [f"SELECT '{c}', '{n}', CAST({f}({c}) AS DOUBLE), NULL FROM lineitem" for n, f in (("average", "avg"), ("mean", "avg"), ("sum", "sum"))]
    return "\nUNION ALL\n".join(rows)


METRICS = f"(SELECT c, i, v + 0.0 AS v, CAST(w AS VARCHAR) AS w FROM ({metrics_sql()}))"
TITLE_SQL = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v} ' || matched_column" for k, v in q.TITLES.items()) + " END"
ERROR_SQL = f"""CASE WHEN intent = 'unknown' THEN 'unknown intent' WHEN intent NOT IN ({", ".join(f"'{k}'" for k in q.TITLES)}) THEN 'not a single figure'
  WHEN matched_column IS NULL THEN 'no matching column'
  WHEN intent IN ('average', 'mean', 'sum') AND matched_column NOT IN ({", ".join(f"'{c}'" for c in NUMERIC)}) THEN 'cannot compute ' || intent || ' on a non-numeric column' END"""


@query("column_metrics_lineitem", f"SELECT c AS matched_column, i AS intent, round(v, 2) AS value, w AS value_text FROM {METRICS}")
def _(t):
    return rounded(q.column_metrics(t("lineitem")), 2)


@query(
    "answers_lineitem",
    f"""SELECT event_id, question, intent, matched_column, CASE WHEN {ERROR_SQL} IS NULL THEN {TITLE_SQL} END AS title, round(v, 2) AS value, w AS value_text,
      {ERROR_SQL} AS error FROM {TAGGED} LEFT JOIN {METRICS} ON c = matched_column AND i = intent""",
)
def _(t):
    return rounded(q.answer_metrics(asked(t), "question", t("lineitem")), 2)


@query(
    "routed_questions_events",
    f"""SELECT CASE intent WHEN 'trend' THEN 'monthly_trend' WHEN 'correlation' THEN 'rank_relationships' WHEN 'anomaly' THEN 'top_anomalies'
      WHEN 'segment' THEN 'segment_summary' WHEN 'cluster' THEN 'segment_summary' WHEN 'unknown' THEN 'none' ELSE 'metrics' END AS analysis,
      intent, subtype, count(*) AS questions FROM {TAGGED} GROUP BY ALL""",
)
def _(t):
    return q.route_questions(asked(t), "question")
