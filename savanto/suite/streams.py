"""Streaming queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from savanto.session import new_path
from savanto.streaming import feeds, state
from savanto.suite.registry import Tables, case, with_views

STAMP = "yyyy-MM-dd HH:mm:ss"


def event_feed(t: Tables):
    """The stored events as a stream, with a time stamp streaming accepts."""
    schema = t.events.schema
    return feeds.read_feed(t.spark, f"{t.folder}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def split_feed(t: Tables, path: str, events):
    """Events rewritten as several files, one per micro-batch."""
    events.repartition(3, "event_id").write.mode("append").parquet(path)
    feed = feeds.read_feed(t.spark, path, t.events.schema, files_per_batch=1)
    return feed.withColumn("ts", F.col("ts").cast("timestamp"))


@case(
    "stream_dedup",
    with_views(
        """select distinct user_id, event_type from events where 'Supplier#' || lpad(user_id::varchar, 9, '0')
           not in (select expert from crosswalk where right(expert, 1) in (select right(r_regionkey::varchar, 1) from region))"""
    ),
)
def stream_dedup(t: Tables):
    """Users and kinds of events that the stored names lack, each once: half the feed, a stop, and the rest."""
    out = new_path(t.spark, "dedup")
    name = F.concat(F.lit("Supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    digits = t.region.select(F.col("r_regionkey").cast("string").alias("last"))
    linked = t.crosswalk().withColumn("last", F.substring("expert", -1, 1)).join(digits, "last", "left_semi")
    stored = t.events.join(linked, name == F.col("expert"), "left_semi").select("user_id", "event_type").distinct()
    stored.write.parquet(f"{out}/stored")
    for half in (0, 1):
        feed = split_feed(t, f"{out}/feed", t.events.where(F.col("event_id") % 2 == half)).select("user_id", "event_type")
        known = feeds.read_feed(t.spark, f"{out}/stored", stored.schema)
        feeds.finish(state.dedup(feed, ["user_id", "event_type"], known, f"{out}/rows", f"{out}/checkpoint"))
    return t.spark.read.schema(stored.schema).parquet(f"{out}/rows")


DUE_SECONDS = 7 * 24 * 3600


@case(
    "recrawl_schedule",
    f"""with g as (select user_id || ':' || event_type as page, ts,
           lead(ts) over (partition by user_id, event_type order by ts) as next, max(ts) over () as newest from events)
       select page, strftime(ts, '%Y-%m-%d %H:%M:%S') as crawled,
       strftime(ts + interval {DUE_SECONDS} second, '%Y-%m-%d %H:%M:%S') as due
       from g where coalesce(next, newest) >= ts + interval {DUE_SECONDS} second""",
)
def recrawl_schedule(t: Tables):
    """Pages (kinds of a user's events) that were not crawled again within seven days, over a restart."""
    out = new_path(t.spark, "recrawl")
    pages = t.events.select(F.concat_ws(":", "user_id", "event_type").alias("page"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = pages.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    cuts = [None, *[first + (last - first) * k // 3 for k in (1, 2)], None]
    for low, high in zip(cuts, cuts[1:], strict=False):  # one part after another, each run goes on from the one before
        at = F.unix_micros("ts")
        part = pages.where((F.lit(low is None) | (at >= F.lit(low or 0))) & (F.lit(high is None) | (at < F.lit(high or 0))))
        part.write.mode("append").parquet(f"{out}/feed")
        feed = feeds.read_feed(t.spark, f"{out}/feed", pages.schema)
        feeds.finish(state.start_recrawls(feed, "page", "ts", DUE_SECONDS, f"{out}/rows", f"{out}/checkpoint"))
    rows = t.spark.read.schema("page string, crawled timestamp, due timestamp").parquet(f"{out}/rows")
    return rows.select("page", F.date_format("crawled", STAMP).alias("crawled"), F.date_format("due", STAMP).alias("due"))


def leaderboard_feed(t: Tables) -> str:
    """Users play writers named like suppliers; those with a linked account enter the leaderboard. The tables' folder."""
    out = new_path(t.spark, "leaderboard")
    feed = split_feed(t, f"{out}/feed", t.events).select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("expert"),
        F.col("event_type").alias("topic"),
        F.col("value").alias("views"),
        "ts",
    )
    feeds.finish(feeds.leaderboard_update(feed, t.crosswalk(), f"{out}/tables", f"{out}/checkpoint", every=2))
    return f"{out}/tables"


@case(
    "stream_leaderboard",
    with_views(
        """select event_type as topic, 'Supplier#' || lpad(user_id::varchar, 9, '0') as expert,
           arg_max(value, ts) as views from events
           where 'Supplier#' || lpad(user_id::varchar, 9, '0') in (select expert from crosswalk) group by 1, 2"""
    ),
)
def stream_leaderboard(t: Tables):
    return feeds.read_leaderboard(t.spark, leaderboard_feed(t))


@case("stream_topics", "select distinct 'Supplier#' || lpad(user_id::varchar, 9, '0') as expert, event_type as topic from events")
def stream_topics(t: Tables):
    return feeds.read_topics(t.spark, leaderboard_feed(t))


@case("stream_resume", "select user_id, count(*) as n from events group by 1")
def stream_resume(t: Tables):
    """Counts per user: half the feed, a stop, then the rest from the same checkpoint."""
    out = new_path(t.spark, "resume")
    for half in (0, 1):
        feed = split_feed(t, f"{out}/feed", t.events.where(F.col("event_id") % 2 == half))
        run = feeds.start_deltas(feeds.counts(feed, "user_id"), f"{out}/deltas", f"{out}/checkpoint", "update")
        feeds.finish(run)
    return feeds.read_deltas(t.spark, f"{out}/deltas", ["user_id"], "n")


@case(
    "stream_latest",
    "select user_id as url, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as ts from events group by 1",
)
def stream_latest(t: Tables):
    out = new_path(t.spark, "latest")
    feed = split_feed(t, f"{out}/feed", t.events).withColumnRenamed("user_id", "url")
    run = feeds.start_deltas(feeds.latest(feed, "url", "ts"), f"{out}/deltas", f"{out}/checkpoint", "update")
    feeds.finish(run)
    rows = feeds.read_deltas(t.spark, f"{out}/deltas", ["url"], "ts")
    return rows.select("url", F.date_format("ts", STAMP).alias("ts"))


QUOTA_SQL = """select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as requests
    from events group by 1 having count(*) > 20"""


@case("window_quota", QUOTA_SQL)
def window_quota(t: Tables):
    busy = feeds.quota(t.events, "ts", "1 hour", 20)
    return busy.select(F.date_format("start", STAMP).alias("start"), "requests")


@case(
    "stream_quota",
    f"""select * from ({QUOTA_SQL}) where start < (select strftime(time_bucket(interval 1 hour, max(ts)),
        '%Y-%m-%d %H:%M:%S') from events)""",
)
def stream_quota(t: Tables):
    """The same over the stream: windows come out once the watermark has passed them, so the last one stays open."""
    out = new_path(t.spark, "quota")
    rows = feeds.quota(event_feed(t).withWatermark("ts", "0 seconds"), "ts", "1 hour", 20)
    feeds.finish(feeds.start_rows(rows, f"{out}/rows", f"{out}/checkpoint"))
    done = t.spark.read.schema(rows.schema).parquet(f"{out}/rows")
    return done.select(F.date_format("start", STAMP).alias("start"), "requests")
