"""The queries with SQL on the smallest tables."""

import os

import pytest

from savanto.llm.queries import QUERIES, SQL
from tests.oracle import connect, differences

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None
