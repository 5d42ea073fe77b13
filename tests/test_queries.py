"""Every query beside its SQL on the small tables; those without SQL must run and return rows."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

BASE = "/root/testdata/sf0.01"
CORE = {k for m in entry._MODULES for k in __import__(m, fromlist=["QUERIES"]).QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, BASE).count() > 0
    else:
        assert compare(spark, con, entry.queries()[name], sql, BASE) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "target_name" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
