"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from savanto.suite import load
from tests.oracle import connect, differences

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load()))
def test_same_rows_as_sql(spark, con, name):
    case = load()[name]
    if case.sql is None:
        assert case.run(spark, FOLDER).count() >= 0
    else:
        assert differences(case.run(spark, FOLDER), con, case.sql) is None


#: Queries whose ties and orders showed on larger tables only.
LARGER = ["cover_density", "positional_search", "revisions", "timeline", "top_in_tag", "fk_deref", "seek_pages", "upsert_delta", "near_words"]
LARGER_FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER_FOLDER)


@pytest.mark.parametrize("name", LARGER)
def test_same_rows_as_sql_on_larger_tables(spark, larger, name):
    case = load()[name]
    assert differences(case.run(spark, LARGER_FOLDER), larger, case.sql) is None
