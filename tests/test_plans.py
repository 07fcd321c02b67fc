"""Catalogue, findings, questions, sources, sinks, and the shape of physical plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions.labels import missing_flag, score_band, severity_label, strength_label
from tablescope.operators import describe, quality, relations, series
from tablescope.operators.describe import column_moments
from tablescope.plans import catalog, findings, questions
from tablescope.sources.csv import read_csv, unique_names
from tablescope.sources.sinks import write_findings, write_labeled_csv


def test_labels(spark):
    df = spark.createDataFrame([(80.0, 0.7), (50.0, -0.4), (49.9, 0.1), (81.0, -0.9)], "s double, r double")
    assert [r[0] for r in df.select(score_band(F.col("s"))).collect()] == ["Excellent", "Fair (Warning)", "Critical Danger", "Excellent"]
    assert [r[0] for r in df.select(strength_label(F.col("r"))).collect()] == ["strong positive", "moderate negative", "weak positive", "strong negative"]
    assert [r[0] for r in df.select(severity_label(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "CRITICAL"]
    assert [r[0] for r in df.select(missing_flag(F.col("s") - 75)).collect()] == [False, False, False, True]


def test_catalogue(spark):
    tables = {
        "sales": spark.sql("SELECT 1 order_id, 2 price, current_date() day"),
        "plain": spark.sql("SELECT 1 a"),
        "ticks": spark.sql("SELECT current_timestamp() t"),
        "people": spark.sql("SELECT 'x' email"),
        "money": spark.sql("SELECT 1 cost, 2 margin"),
    }
    got = {r["table"]: r for r in catalog.catalog_profile(tables).collect()}
    assert got["sales"]["dataset_type"] == "Temporal Transaction Dataset"
    assert got["sales"]["modules"].startswith("Timeline Intelligence, Correlation Discovery")
    assert got["plain"]["dataset_type"] == "General Tabular Dataset"
    assert got["ticks"]["dataset_type"] == "Time Series Dataset"
    assert got["people"]["dataset_type"] == "Customer Dataset" and got["money"]["dataset_type"] == "Financial Dataset"
    rich = {r["table"]: r["richness"] for r in catalog.richness_score(catalog.schema_catalogue(tables)).collect()}
    assert rich["plain"] == 1.5 and rich["sales"] > rich["money"]


def test_recommendations(spark):
    df = spark.createDataFrame(
        [("all", True, 50.0, 10.0, 90.0), ("none", False, 45.0, 65.0, 40.0), ("gaps", None, None, None, None)],
        "name string, has_date boolean, clusterability double, stability double, complexity double",
    )
    got = {}
    for r in findings.recommend_analyses(df, "name").orderBy("name", "position").collect():
        got.setdefault(r["name"], []).append(r["title"])
    assert got["all"] == ["Timeline Intelligence", "Segment Discovery", "Anomaly Detection", "Correlation Discovery"]
    assert got["none"] == got["gaps"] == ["Dataset DNA Profile"]


def test_findings_fall_back(spark):
    df = spark.range(100).select(F.when(F.col("id") > 1, F.col("id")).alias("x"))
    assert [r["rule"] for r in findings.generate_findings(df).collect()] == ["none"]
    labelled = spark.range(100).select("id", F.lit("Normal").alias("flag"))
    rules = {r["rule"] for r in findings.generate_findings(labelled, anomaly="flag").collect()}
    assert rules == {"complete", "no_anomalies"}


COLUMNS = ["Order_Date", "Total_Sales_USD", "Quantity", "Age"]


@pytest.mark.parametrize(
    "text, intent, loose, column",
    [
        ("What is the average quantity?", "average", "average", "Quantity"),
        ("Total revenue please", "sum", "sum", "Total_Sales_USD"),
        ("how many order date", "count", "count", "Order_Date"),
        ("sales by country", "unknown", "count", "Total_Sales_USD"),
        ("most related columns", "maximum", "maximum", None),
        ("average age", "average", "average", "Age"),
        ("weird rows", "anomaly", "anomaly", None),
        ("describe the clusters", "cluster", "cluster", None),
    ],
)
def test_tagging(spark, text, intent, loose, column):
    df = spark.createDataFrame([(text,)], "q string")
    got = questions.tag_questions(df, "q", COLUMNS).first()
    assert (got["intent"], got["matched_column"]) == (intent, column)
    assert questions.tag_questions(df, "q", COLUMNS, parity=True).first()["intent"] == loose


def test_answers(spark):
    data = spark.createDataFrame([(1, "x", 2.0), (3, "y", None)], "years int, city string, pay double")
    asked = spark.createDataFrame(
        [("mean pay",), ("average city",), ("maximum city",), ("count pay",), ("total",), ("hello",), ("strongest correlation",), ("trend of pay",)], "q string"
    )
    got = {r["q"]: r for r in questions.answer_metrics(asked, "q", data).collect()}
    assert got["mean pay"]["value"] == 2.0 and got["mean pay"]["title"] == "Mean pay"
    assert got["average city"]["error"] == "cannot compute average on a non-numeric column"
    assert got["maximum city"]["value_text"] == "y" and got["count pay"]["value"] == 1
    assert got["total"]["error"] == "no matching column" and got["hello"]["error"] == "unknown intent"
    assert got["strongest correlation"]["error"] == "not a single figure"
    routed = {r["intent"]: (r["analysis"], r["subtype"]) for r in questions.route_questions(asked, "q").collect()}
    assert routed["correlation"] == ("rank_relationships", "strongest") and routed["trend"][0] == "monthly_trend"


def test_unique_names():
    assert unique_names(["x", "y", "x", "x"]) == ["x", "y", "x_2", "x_3"]
    assert unique_names(["x", "x_2", "x"]) == ["x", "x_2", "x_3"]


@pytest.mark.parametrize("encoding", ["utf-8", "latin1", "utf-16"])
def test_csv_encodings(spark, tmp_path, encoding):
    path = tmp_path / "in.csv"
    path.write_bytes('name,n,n\n"Zoë, the ""first""",1,2.5\nÅsa,2,3.5\n'.encode(encoding))
    got = read_csv(spark, str(path)).orderBy("n").collect()
    assert [r["name"] for r in got] == ['Zoë, the "first"', "Åsa"]
    assert [(r["n"], r["n_2"]) for r in got] == [(1, 2.5), (2, 3.5)]


def test_csv_quoted_newline(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a,b\n"line one\nline two",1\nx,2\n')
    assert read_csv(spark, str(path)).count() == 2


@pytest.mark.parametrize("split", [7, 40, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_split_inside_quotes(spark, tmp_path, split, end):
    """Byte ranges that begin or lie wholly inside a quoted field give the same as whole files."""
    rng = np.random.default_rng(split)
    for name in ("one.csv", "two.csv"):
        rows = ['n,"text ""with""' + end + 'a break",x']
        for i in range(60):
            field = "".join(rng.choice(["a", end, '""', ",", " ", "é", "long word "]) for _ in range(rng.integers(0, 30)))
            rows.append(f'{i},"{field}",{i / 4}' if i % 3 else f"{i},plain,")
        (tmp_path / name).write_bytes((end.join(rows) + (end if name == "one.csv" else "")).encode())
    path = str(tmp_path)
    whole = spark.read.options(multiLine="true", escape='"', header="true", inferSchema="true").csv(path)
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = read_csv(spark, path)
        assert [f.dataType for f in found.schema] == [f.dataType for f in whole.schema]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
        assert found.rdd.getNumPartitions() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_csv_latin1_with_breaks_and_no_records(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('a,b\n"Zoë\nÅsa",1\n"\x1e",2\n'.encode("latin1"))
    assert sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).collect()) == [("Zoë\nÅsa", 1), ("\x1e", 2)][::-1]
    (tmp_path / "b.csv").write_text('"a\nb",c\n')
    empty = read_csv(spark, str(tmp_path / "b.csv"))
    assert empty.columns == ["a\nb", "c"] and empty.collect() == []
    (tmp_path / "c.csv").write_bytes(b'a,b\r"x\ry",1\r')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "c.csv")).collect()] == [("x\ny", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    labels = spark.createDataFrame([(1, "Anomaly")], "k int, is_anomaly string")
    write_labeled_csv(df, labels, "k", str(tmp_path / "out"))
    got = {r["k"]: r["is_anomaly"] for r in read_csv(spark, str(tmp_path / "out")).collect()}
    assert got == {1: "Anomaly", 2: None}
    for fmt in ("parquet", "json"):
        write_findings(findings.generate_findings(df), str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 1
    with pytest.raises(ValueError):
        write_findings(df, str(tmp_path / "x"), "xlsx")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LINES = "/root/testdata/sf0.001/lineitem.parquet"


def test_plans_prune_and_never_cross_join(spark):
    lines = spark.read.parquet(LINES)
    for df in (
        quality.iqr_audit(lines, ["l_quantity"]),
        relations.pearson_pairs(lines, ["l_quantity", "l_tax"]),
        relations.mutual_information(lines, ["l_quantity", "l_tax"]),
        column_moments(lines, ["l_quantity"]),
        series.change_events(series.resample_sum(lines, "l_shipdate", "l_tax", by="l_suppkey"), by="l_suppkey"),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text
        assert "l_comment" not in text and "l_extendedprice" not in text  # only the used columns are read
    trend = plan(describe.monthly_trend(lines, "l_shipdate", "l_tax"))
    assert "IsNotNull(l_shipdate)" in trend and "IsNotNull(l_tax)" in trend  # pushed to the scan


def test_series_need_one_sort(spark):
    lines = spark.read.parquet(LINES)
    text = plan(series.change_events(series.resample_sum(lines, "l_shipdate", "l_tax", by="l_suppkey"), by="l_suppkey"))
    assert text.count("Join") == 0
    assert text.count("hashpartitioning(l_suppkey") <= 3
