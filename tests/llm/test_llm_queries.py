"""The queries on texts beside their SQL."""

import os

import pytest

from graphloom.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

BASE = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test data here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert compare(spark, connect(BASE), QUERIES[name], SQL[name], BASE) == ""
    else:
        assert QUERIES[name](spark, BASE).count() > 0
