"""Item feeds: last-crawled state, quota windows and leaderboard updates.

Results are kept as append-only deltas, one folder per micro-batch, already reduced to one row per
key. Rewriting a folder on a retry makes a batch idempotent, and a reader reduces the deltas again.
So no batch rewrites the whole table, and a restart goes on from the checkpoint. The leaderboard's
deltas are compacted (:mod:`savanto.streaming.compaction`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from savanto.operators.upsert import zset_last_wins
from savanto.streaming.compaction import BATCH, Deltas


def read_feed(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder (or glob) of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def quota(feed: DataFrame, ts: str, width: str, limit: int) -> DataFrame:
    """Tumbling windows with more than ``limit`` requests: ``(start, requests)``. Batch or stream."""
    counts = feed.groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("requests"))
    return counts.where(F.col("requests") > limit).select(F.col("window.start").alias("start"), "requests")


def latest(feed: DataFrame, key: str, ts: str) -> DataFrame:
    """Last-crawled time per key as running state (update mode)."""
    return feed.groupBy(key).agg(F.max(ts).alias(ts))


def counts(feed: DataFrame, key: str) -> DataFrame:
    """Items per key as running state (update mode)."""
    return feed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def start_deltas(
    stream: DataFrame, path: str, checkpoint: str, mode: str, reduce: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Write each micro-batch, optionally reduced, to its own folder until the feed is used up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = reduce(batch) if reduce else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a Parquet folder until the feed is used up."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def finish(query: StreamingQuery) -> None:
    """Wait for the end of the feed; a failure of the stream raises here."""
    query.awaitTermination()


def read_deltas(spark: SparkSession, path: str, key: Sequence[str], value: str, order: str | Column = "batch") -> DataFrame:
    """The newest value of every key over all deltas."""
    return zset_last_wins(spark.read.parquet(path), key, value, order)


EXPERTS = "expert string, views double, ts timestamp"
TOPICS = "expert string, topic string"
LEADERBOARD = "topic string, expert string, views double, ts timestamp"


def leaderboard_tables(path: str, every: int = 8) -> dict[str, Deltas]:
    """The newest profile of each expert, the topics of each expert, and the leaderboard: by event time."""
    newest = lambda *key: lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct("views", "ts", BATCH), "ts").alias("r")).select(*key, "r.*")
    return {
        "experts": Deltas(f"{path}/experts", StructType.fromDDL(EXPERTS), newest("expert"), every),
        "topics": Deltas(f"{path}/topics", StructType.fromDDL(TOPICS), lambda rows: rows.groupBy("expert", "topic").agg(F.min(BATCH).alias(BATCH)), every),
        "leaderboard": Deltas(f"{path}/leaderboard", StructType.fromDDL(LEADERBOARD), newest("topic", "expert"), every),
    }


def leaderboard_update(feed: DataFrame, matched: DataFrame, path: str, checkpoint: str, every: int = 8) -> StreamingQuery:
    """Items ``(expert, topic, views, ts)`` into three delta tables, compacted every few batches: expert profiles, the
    topics of each expert, and the leaderboard of linked experts."""
    tables = leaderboard_tables(path, every)

    def write(batch: DataFrame, batch_id: int) -> None:
        tables["experts"].write(batch, batch_id)
        tables["topics"].write(batch, batch_id)
        tables["leaderboard"].write(batch.join(matched.select("expert"), "expert", "left_semi"), batch_id)

    return (
        feed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, expert, views)`` by event time."""
    return leaderboard_tables(path)["leaderboard"].read(spark).select("topic", "expert", "views")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """The set of topics of every expert."""
    return leaderboard_tables(path)["topics"].read(spark).select("expert", "topic")
