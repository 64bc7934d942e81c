"""Pages of a stored order, at any depth, from one or two of its files."""

import random

import pytest
from pyspark.sql import functions as F

from savanto.operators.seek import StoredOrder
from savanto.session import new_path


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1.0, 2.5, None, 7.0, 9.25]), f"r{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, price double, name string")
    order = StoredOrder.build(df, [F.desc_nulls_last("price"), F.col("id")], new_path(spark, "order"), range_rows=90)
    return order, sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))


@pytest.mark.parametrize("offset, size", [(0, 10), (0, 1), (85, 30), (500, 40), (990, 50), (999, 1), (1000, 5), (5000, 1), (0, 1000)])
def test_pages(spark, stored, offset, size):
    order, rows = stored
    page = order.page(spark, offset, size)
    assert [tuple(r) for r in page.collect()] == rows[offset : offset + size]
    if size <= 50:
        assert len(page.inputFiles()) <= 2


@pytest.mark.parametrize("size", [1, 7, 100, 999, 5000])
def test_the_total_does_not_depend_on_the_page_size(spark, stored, size):
    order, rows = stored
    assert order.total(spark) == len(rows)
    if size >= 100:
        pages = [order.page(spark, at, size).count() for at in range(0, len(rows), size)]
        assert sum(pages) == len(rows) and all(n == size for n in pages[:-1])


def test_places_are_in_the_scans_filters(spark, stored):
    plan = stored[0].page(spark, 300, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(__place" in plan and "LessThan(__place" in plan


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id bigint")
    order = StoredOrder.build(empty, [F.col("id")], new_path(spark, "order"))
    assert order.total(spark) == 0 and order.page(spark, 0, 5).count() == 0 and order.page(spark, 0, 5).columns == ["id"]
