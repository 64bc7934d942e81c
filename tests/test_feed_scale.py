"""What keyed feeds hand to Python, and how many tasks write them."""

import datetime as dt
import glob

from savanto.session import new_path, shared_folder
from savanto.streaming import feeds, state
from savanto.suite import load


def test_rows_whose_like_came_before_end_in_the_state_store(spark):
    out, schema = new_path(spark, "dedup"), "site string, item bigint"

    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/{name}")

    add("stored", [("a", 1)])
    for rows in ([("a", 1), ("b", 2), ("b", 2), (None, 3)], [("b", 2)] * 5 + [("a", 1), (None, 3), ("c", 4)]):
        add("feed", rows)
    feed, known = (feeds.read_feed(spark, f"{out}/{n}", spark.createDataFrame([], schema).schema, 1) for n in ("feed", "stored"))
    query = state.dedup(feed, ["site", "item"], known, f"{out}/rows", f"{out}/checkpoint")
    feeds.finish(query)
    got = spark.read.schema(schema).parquet(f"{out}/rows").collect()
    assert sorted(map(str, got)) == sorted(f"Row(site={s!r}, item={i})" for s, i in [("b", 2), (None, 3), ("c", 4)])
    dropped = [o["customMetrics"].get("numDroppedDuplicateRows", 0) for p in query.recentProgress for o in p["stateOperators"]]
    assert sum(dropped) == 8  # the repeats of one batch and of the one before


def test_a_part_of_the_crawls_is_written_by_many_tasks(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(i, day(i % 24), i % 7, "view") for i in range(400)]
    folder = new_path(spark, "events")
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string").repartition(4).write.parquet(f"{folder}/events.parquet")
    got = load()["recrawl_schedule"].run(spark, folder).collect()
    times = {u: sorted({r[1] for r in rows if r[2] == u}) for u in range(7)}
    late = [(f"{u}:view", a) for u, ts in times.items() for a, b in zip(ts, [*ts[1:], day(23)]) if b - a >= dt.timedelta(days=7)]
    assert sorted((r.page, r.crawled) for r in got) == sorted((p, str(a)) for p, a in late)
    newest = max(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/recrawl-*/feed"), key=lambda p: len(glob.glob(f"{p}/part-*")))
    assert len(glob.glob(f"{newest}/part-*")) > 3
