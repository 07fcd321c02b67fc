"""Tables of analytical questions: tagging, column matching, answers.

Keywords and column names are known when the plan is written, so tagging and
matching are plain expressions over the question text: no join, no UDF.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablescope.functions.columns import clean, col, literal_rows, number, numeric_columns

# fixed values: keywords of every intent, tried in this order
INTENTS = {
    "average": ["average", "avg"],
    "mean": ["mean"],
    "maximum": ["maximum", "max", "highest", "most", "largest"],
    "minimum": ["minimum", "min", "lowest", "least", "smallest"],
    "sum": ["sum", "total"],
    "count": ["count", "how many", "number of"],
    "trend": ["trend", "over time", "history"],
    "correlation": ["correlation", "correlations", "correlate", "related", "relationship"],
    "anomaly": ["anomaly", "anomalies", "outlier", "outliers", "unusual", "weird"],
    "segment": ["segment", "segments", "segmentation"],
    "cluster": ["cluster", "clusters", "clustering", "group"],
}

# fixed values: words of every sub-type, tried in this order
SUBTYPES = {
    "correlation": {
        "strongest": ["strongest", "highest", "max", "best", "most correlated"],
        "top": ["top", "rank", "best 10", "top 10", "list"],
    },
    "anomaly": {
        "top": ["top", "extreme", "most", "worst", "highest", "rank"],
        "count": ["count", "number", "how many", "total"],
        "show": ["show", "list", "table", "records", "outliers"],
    },
    "segment": {
        "largest": ["largest", "biggest", "most populated", "dominant", "main"],
        "summary": ["summary", "profile", "traits", "characteristics", "describe"],
    },
}

# fixed values: business words and what columns may call them
SYNONYMS = {
    "revenue": ["sales", "price", "amount", "income", "turnover"],
    "sales": ["revenue", "price", "amount", "qty", "quantity"],
    "profit": ["earnings", "margin", "gain"],
}

# fixed values: titles of the metrics
TITLES = {
    "average": "Average",
    "mean": "Mean",
    "maximum": "Maximum",
    "minimum": "Minimum",
    "sum": "Total",
    "count": "Count of",
}

# analyses that answer the intents which are not single figures
FAMILIES = {
    "trend": "monthly_trend",
    "correlation": "rank_relationships",
    "anomaly": "top_anomalies",
    "segment": "segment_summary",
    "cluster": "segment_summary",
}


def _has_any(text: Column, words: list[str], parity: bool) -> Column:
    lowered = F.lower(text)
    if parity:
        return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])
    return lowered.rlike(r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b")


def tag_intent(text: Column, parity: bool = False) -> Column:
    """The first intent whose keywords occur; whole words, or any substring with ``parity``."""
    tests = [F.when(_has_any(text, words, parity), F.lit(name)) for name, words in INTENTS.items()]
    return F.coalesce(*tests, F.lit("unknown"))


def tag_subtype(text: Column, intent: Column, parity: bool = False) -> Column:
    """What kind of correlation, anomaly or segment answer is wanted; NULL for other intents."""
    out = F.lit(None).cast("string")
    for name, kinds in SUBTYPES.items():
        asked = F.coalesce(*[F.when(_has_any(text, w, parity), F.lit(k)) for k, w in kinds.items()], F.lit("general"))
        same = intent.isin("segment", "cluster") if name == "segment" else intent == name
        out = F.when(same, asked).otherwise(out)
    return out


def match_column(text: Column, columns: list[str]) -> Column:
    """The column a question names: by name, by business synonym, then by one of its words."""
    lowered = F.lower(text)
    tests = []
    for c in columns:
        name = c.lower()
        tests.append(F.when(lowered.contains(name.replace("_", " ")) | lowered.contains(name), F.lit(c)))
    for word, others in SYNONYMS.items():
        target = next((c for w in [word, *others] for c in columns if w in c.lower()), None)
        if target is not None:
            tests.append(F.when(lowered.rlike(rf"\b{word}\b"), F.lit(target)))
    for c in columns:
        for token in re.split(r"[\s_]+", c.lower()):
            if len(token) > 2:  # fixed value: words of three letters or more
                tests.append(F.when(lowered.rlike(rf"\b{re.escape(token)}\b"), F.lit(c)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def tag_questions(questions: DataFrame, text: str, columns: list[str], parity: bool = False) -> DataFrame:
    """Add ``intent, subtype, matched_column``; correlations and anomalies name no column."""
    tagged = questions.withColumn("intent", tag_intent(col(text), parity))
    return tagged.withColumn("subtype", tag_subtype(col(text), F.col("intent"), parity)).withColumn(
        "matched_column", F.when(~F.col("intent").isin("correlation", "anomaly"), match_column(col(text), columns))
    )


def column_metrics(df: DataFrame) -> DataFrame:
    """``matched_column, intent, value, value_text``: every single-figure answer of a table, from one aggregate."""
    numeric = set(numeric_columns(df))
    wide = df.agg(
        *[
            F.struct(
                F.count(clean(df, c)).alias("n"),
                F.min(clean(df, c)).cast("string").alias("low_text"),
                F.max(clean(df, c)).cast("string").alias("high_text"),
                *[
                    (f(number(df, c)) if c in numeric else F.lit(None).cast("double")).alias(n)
                    for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg), ("total", F.sum))
                ],
            ).alias(f"c{i}")
            for i, c in enumerate(df.columns)
        ]
    )
    rows = []
    for i, c in enumerate(df.columns):
        cell = F.col(f"c{i}")
        answers = {
            "maximum": (cell["high"], cell["high_text"]),
            "minimum": (cell["low"], cell["low_text"]),
            "count": (cell["n"], None),
        }
        if c in numeric:
            total = F.coalesce(cell["total"], F.lit(0.0))
            answers |= {"average": (cell["mean"], None), "mean": (cell["mean"], None), "sum": (total, None)}
        for intent, (value, words) in answers.items():
            text = F.lit(None) if words is None or c in numeric else words
            rows.append(
                F.struct(
                    F.lit(c).alias("matched_column"),
                    F.lit(intent).alias("intent"),
                    value.cast("double").alias("value"),
                    text.cast("string").alias("value_text"),
                )
            )
    return wide.select(F.inline(F.array(*rows)))


def answer_metrics(questions: DataFrame, text: str, df: DataFrame, parity: bool = False) -> DataFrame:
    """Answer every single-figure question of a table about ``df``.

    The metrics of all columns are computed once; the joined table has six rows
    per column.  Questions without a figure, a column or a fitting type get an
    error text.
    """
    tagged = tag_questions(questions, text, df.columns, parity)
    answered = tagged.join(F.broadcast(column_metrics(df)), ["matched_column", "intent"], "left")
    numeric = numeric_columns(df)
    intent, column = F.col("intent"), F.col("matched_column")
    title = F.lit(None).cast("string")
    for name, words in TITLES.items():
        title = F.when(intent == name, F.concat(F.lit(words + " "), column)).otherwise(title)
    error = (
        F.when(intent == "unknown", "unknown intent")
        .when(~intent.isin(*TITLES), "not a single figure")
        .when(column.isNull(), "no matching column")
        .when(intent.isin("average", "mean", "sum") & ~column.isin(*numeric), F.concat(F.lit("cannot compute "), intent, F.lit(" on a non-numeric column")))
    )
    return answered.select(
        *[col(c) for c in questions.columns],
        "intent",
        "matched_column",
        F.when(error.isNull(), title).alias("title"),
        "value",
        "value_text",
        error.alias("error"),
    )


def route_questions(questions: DataFrame, text: str, parity: bool = False) -> DataFrame:
    """``analysis, intent, subtype, questions``: how many questions each analysis has to answer."""
    tagged = questions.withColumn("intent", tag_intent(col(text), parity))
    tagged = tagged.withColumn("subtype", tag_subtype(col(text), F.col("intent"), parity))
    counts = tagged.groupBy("intent", "subtype").agg(F.count("*").alias("questions"))
    routes = literal_rows(
        questions.sparkSession,
        [[F.lit(i), F.lit(a)] for i, a in (FAMILIES | {i: "metrics" for i in TITLES}).items()],
        ["intent", "analysis"],
    )
    # counts: one row per intent and sub-type
    return counts.join(F.broadcast(routes), "intent", "left").select(
        F.coalesce("analysis", F.lit("none")).alias("analysis"), "intent", "subtype", "questions"
    )
