import pytest
from comparing import differences, duck
from pyspark.sql import functions as F

from tablescope.llm import licenses, lines, queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op8_license_scans", "op9_line_dedup"])
def test_queries_against_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert differences(df, duck(FOLDER), queries.SQL[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_lines(spark):
    rows = [(i, f"Menu \nunique {i}\n\nrare", f"s{i % 4}") for i in range(8)]
    rows += [(20, None, "s0"), (21, "", "s1"), (22, "Menu", None), (23, "\tMenu", "s9"), (23, "\tMenu", "s9"), (24, "only here\n" * 50000, "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("clean", F.lit(1))
    found = lines.remove_boilerplate(docs, min_sites=5)
    assert found.columns == ["doc_id", "text", "source", "clean", "n_lines", "n_removed"]
    got = {(r["doc_id"], r["clean"], r["n_lines"], r["n_removed"]) for r in found.collect()}
    want = {(i, f"unique {i}\n\nrare", 4, 1) for i in range(8)}
    want |= {(20, None, 1, 0), (21, "", 1, 0), (22, "", 1, 1), (23, "", 1, 1), (24, "only here\n" * 50000, 50001, 0)}
    assert got == want and found.count() == len(rows)
    kept = lines.remove_boilerplate(docs, min_sites=5, most=0.5).where("doc_id in (22, 23)")
    assert sorted(r["clean"] for r in kept.collect()) == ["\tMenu", "\tMenu", "Menu"]
    assert lines.remove_boilerplate(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sites", [95, 100, 105])
def test_near_the_threshold(spark, sites):
    """Around the threshold the exact count decides."""
    rows = [(i, f"shared line\nown {i}", f"site {i}") for i in range(sites)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = lines.boilerplate(docs, min_sites=100)
    assert bad.count() == (1 if sites >= 100 else 0)


def test_licenses(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 200)
    changed = "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;").replace("SUBLICENSE", "sublicence")
    rows = [
        (1, changed), (2, mit + " and more"), (3, None), (4, ""), (5, "code\n# Licenced under the APACHE Licence -- version 2.0\nmore"),
        (6, "all rights reserved"), (6, "all rights reserved"), (None, "Released under the MIT License!"), (7, "Copyright by nobody"),
        (8, "x " * 50000 + "\nAll rights reserved."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("License", F.lit("clash"))
    found = licenses.scan_licenses(docs, licenses.known_licenses(spark))
    assert found.columns == ["doc_id", "text", "license", "notices"]
    got = sorted(((r["doc_id"], r["license"], tuple(r["notices"])) for r in found.collect()), key=repr)
    arr = "LicenseRef-all-rights-reserved"
    want = [
        (1, "MIT", ("MIT",)), (2, None, ()), (3, None, ()), (4, None, ()), (5, None, ("Apache-2.0",)), (6, arr, (arr,)), (6, arr, (arr,)),
        (None, "MIT", ("MIT",)), (7, None, ()), (8, None, (arr,)),
    ]
    assert got == sorted(want, key=repr)
    assert licenses.scan_licenses(docs.limit(0), licenses.known_licenses(spark)).collect() == []
    assert licenses.scan_licenses(docs, licenses.known_licenses(spark).limit(0)).where("license is not null").collect() == []
