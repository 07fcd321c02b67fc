"""Every registered query at the smallest scale, against its SQL where it has one."""

import os

import pytest

import __spark_entry__ as entries
from catalogue import REGISTRY
from comparing import differences, duck

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = entries.queries()[name](spark, FOLDER)
    sql = entries.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, sql) == []


def test_entry(spark):
    assert entries.entry(spark).columns[0] == "column"
