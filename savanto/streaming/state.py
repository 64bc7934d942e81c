"""Feed operators with keyed state: what a micro-batch costs follows its own rows, not the history.

State lives in the state store on the executors and in the query's checkpoint, so a restart goes on from it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from savanto.streaming.feeds import start_rows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state on local disk with changes in the checkpoint, not in memory."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def dedup_rows(feed: DataFrame, key: Sequence[str], known: DataFrame) -> DataFrame:
    """The keys of ``feed`` (a stream) that neither it nor ``known`` (a stream of the stored table's files) had
    before, each once.

    The stored keys are read once into the state, before or together with the feed's first rows, and files that are added to
    the stored table later are followed as well. Rows whose like came before end in the state store; a key is
    handed to Python twice at most, once as stored and once as new.
    """
    columns = list(key)
    both = known.select(*columns, F.lit(True).alias("__stored")).unionByName(feed.select(*columns, F.lit(False).alias("__stored"))).dropDuplicates()

    def first(values: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = any([bool(p["__stored"].any()) for p in parts])
        if state.exists:
            return
        state.update((True,))
        if not stored:
            yield pd.DataFrame([values], columns=columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in feed.select(*columns).schema)
    return both.groupBy(*columns).applyInPandasWithState(first, kinds, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def dedup(feed: DataFrame, key: Sequence[str], known: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the new keys of :func:`dedup_rows` to ``path`` until the feed is used up."""
    with rocks_state(feed.sparkSession):
        return start_rows(dedup_rows(feed, key, known), path, checkpoint)


def recrawls(crawls: DataFrame, page: str, ts: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """``(page, crawled, due)``: a page is due ``seconds`` after a crawl that no other one followed until then.

    ``crawls`` is a stream in about the order of ``ts``; a crawl that comes after a later one of its page changes
    nothing. A page's timer is set again by each crawl and goes off when event time, which lags ``late`` behind
    the newest crawl, has passed it.
    """
    wait = seconds * 1_000_000
    kind = dict(crawls.dtypes)[page]

    def watch(values: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({page: [values[0]], "at": [last]})
            return
        times = sorted(int(t) for p in parts for t in p["at"].dropna())
        if state.exists:
            (last,) = state.get
            times = [last, *[t for t in times if t > last]]
        if not times:
            return
        missed = [a for a, b in zip(times, times[1:], strict=False) if b - a >= wait]
        state.update((times[-1],))
        # never in the past: a timer that event time has passed goes off with the next batch
        state.setTimeoutTimestamp(max((times[-1] + wait) // 1000, state.getCurrentWatermarkMs() + 1))
        if missed:
            yield pd.DataFrame({page: [values[0]] * len(missed), "at": missed})

    timed = crawls.select(page, ts, F.unix_micros(ts).alias("at")).withWatermark(ts, late)
    found = timed.groupBy(page).applyInPandasWithState(watch, f"`{page}` {kind}, at bigint", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(page, F.timestamp_micros("at").alias("crawled"), F.timestamp_micros(F.col("at") + wait).alias("due"))


def start_recrawls(crawls: DataFrame, page: str, ts: str, seconds: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append the pages that are due to ``path`` until the feed is used up."""
    with rocks_state(crawls.sparkSession):
        return start_rows(recrawls(crawls, page, ts, seconds), path, checkpoint)
