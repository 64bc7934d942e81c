"""Feeds with keyed state: repeats and timers over batches and restarts."""

import datetime as dt

from pyspark.sql import functions as F

from savanto.session import new_path
from savanto.streaming import feeds, state

DAY = 24 * 3600


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_dedup_over_batches_stored_rows_and_restarts(spark):
    out, schema = new_path(spark, "dedup"), "site string, item bigint"
    add(spark, f"{out}/stored", [("a", 1), ("a", 2), (None, 5)], schema)

    def run():
        feed, known = (feeds.read_feed(spark, f"{out}/{n}", spark.read.schema(schema).parquet(f"{out}/stored").schema, 1 if n == "feed" else None) for n in ("feed", "stored"))
        feeds.finish(state.dedup(feed, ["site", "item"], known, f"{out}/rows", f"{out}/checkpoint"))
        return sorted(map(str, spark.read.schema(schema).parquet(f"{out}/rows").collect()))

    named = lambda *rows: sorted(f"Row(site={s!r}, item={i})" for s, i in rows)
    add(spark, f"{out}/feed", [("a", 1), ("a", 3), ("a", 3), (None, 5), (None, 6)], schema)
    add(spark, f"{out}/feed", [("a", 3), ("b", 1)], schema)
    assert run() == named(("a", 3), (None, 6), ("b", 1))
    add(spark, f"{out}/stored", [("c", 9)], schema)  # stored by someone else meanwhile
    add(spark, f"{out}/feed", [("b", 1), ("a", 2), ("c", 9), ("d", 4), (None, 6)], schema)
    assert run() == named(("a", 3), (None, 6), ("b", 1), ("d", 4))
    assert run() == named(("a", 3), (None, 6), ("b", 1), ("d", 4))  # nothing new


def test_recrawls_over_restarts(spark):
    out, schema = new_path(spark, "recrawl"), "page string, ts timestamp"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parts = [
        [("often", day(0)), ("often", day(1)), ("once", day(0)), ("late", day(0)), (None, day(0))],
        [("often", day(5)), ("often", day(6)), ("late", day(6.5))],
        [("often", day(12)), ("other", day(8)), ("late", day(13)), ("late", day(12.5))],
        [("once", day(20)), ("other", day(14.9))],
        [("late", day(28))],
    ]
    for k, rows in enumerate(parts):
        add(spark, f"{out}/feed", rows, schema)
        feed = feeds.read_feed(spark, f"{out}/feed", spark.createDataFrame([], schema).schema, 1)
        feeds.finish(state.start_recrawls(feed, "page", "ts", 7 * DAY, f"{out}/rows", f"{out}/checkpoint"))
    got = spark.read.schema("page string, crawled timestamp, due timestamp").parquet(f"{out}/rows")
    assert got.where(F.col("due") != F.col("crawled") + F.expr("interval 7 days")).count() == 0
    per_page = {}
    for page, rows in ((p, sorted(r[1] for part in parts for r in part if r[0] == p)) for p in ("often", "once", "late", "other", None)):
        ends = [*rows[1:], day(28)]
        per_page[page] = [a for a, b in zip(rows, ends) if b - a >= dt.timedelta(days=7) and (b != day(28) or a + dt.timedelta(days=7) < day(28) or page == "late")]
    found = {}
    for r in got.collect():
        found.setdefault(r.page, []).append(r.crawled)
    assert {p: sorted(v) for p, v in found.items()} == {p: v for p, v in per_page.items() if v}
