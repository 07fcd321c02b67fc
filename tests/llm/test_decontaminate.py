import pytest
from comparing import differences, duck
from pyspark.sql import functions as F

from tablescope.llm import decontaminate, queries

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, "Short Item"), (3, None), (4, "..."), (None, "nameless thing"), (2, "Short Item"), (10, ITEM + " nu")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    name = "op7_benchmark_decontamination"
    assert differences(queries.QUERIES[name](spark, folder), duck(folder), queries.SQL[name]) == []


@pytest.mark.parametrize("most", [500_000, 1])
def test_hits(spark, benchmark, most):
    body = "beta, gamma-delta EPSILON zeta eta theta iota kappa lambda"
    rows = [
        (1, f"é {body} mu Ω"), (2, "a short\nitem b"), (3, None), (4, ""), (5, "beta gamma delta"), (6, "Nameless! thing"),
        (7, "shortitem"), (7, "shortitem"), (8, "x " * 50000 + "short item"), (None, "short item"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash"))
    found = decontaminate.find_contamination(docs, benchmark, slice_windows=most)
    assert found.columns == ["doc_id", "text", "n_words", "hit_words", "hit_spans", "items"]
    got = {(r["doc_id"], r["n_words"], tuple(r["hit_words"]), tuple(r["items"])) for r in found.collect()}
    assert got == {
        (1, 13, tuple(range(1, 12)), ("1", "10")), (2, 4, (1, 2), ("2",)), (3, 0, (), ()), (4, 0, (), ()), (5, 3, (), ()),
        (6, 2, (0, 1), ()), (7, 1, (), ()), (8, 50002, (50000, 50001), ("2",)), (None, 2, (0, 1), ("2",)),
    }
    span = {r["doc_id"]: r["hit_spans"] for r in found.collect()}[1]
    assert rows[0][1].encode()[span[0] : span[1]].decode() == body + " mu"


def test_removal(spark, benchmark):
    rows = [(1, "one two three four short item five six"), (2, "short item"), (3, None), (4, ""), (5, "clean  text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.remove_contamination(docs, benchmark).collect())
    assert got == [(1, "one two three four five six"), (3, None), (4, ""), (5, "clean  text")]


def test_empty_tables(spark, benchmark):
    docs = spark.createDataFrame([(1, "short item")], "doc_id long, text string")
    assert decontaminate.find_contamination(docs.limit(0), benchmark).collect() == []
    row = decontaminate.find_contamination(docs, benchmark.limit(0)).first()
    assert (row["n_words"], row["hit_words"], row["items"]) == (2, [], [])
