"""Exact deduplication of a batch against immutable snapshots.

A snapshot is written once: its distinct digests in exact buckets, and a static binary fuse filter for
each bucket. The digests of a new batch are grouped by themselves, screened by the filter of their
bucket, and only what the filter lets through joins the exact buckets. Every group of equal digests is
then compared by its bytes; should texts differ under one digest, they are told apart by the texts.

Null texts count as empty, and empty texts are equal to each other. Of equal texts the row with the
largest id stays; rows that repeat an id share its result (null ids count as lowest and equal). An empty
table gives an empty result. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savanto.llm import fuse
from savanto.llm.common import whole_text
from savanto.session import new_path, written

#: Digests in a bucket, about. A bucket's keys and filter are what one task holds at once.
BUCKET = 2048
#: A digest is hot with this share of all rows or more; so there are at most HOT_DIGESTS of them.
HOT_DIGESTS = 1024


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass(frozen=True)
class Snapshot:
    """Where a snapshot is stored, and into how many buckets."""

    folder: str
    buckets: int


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def _keys(digests: pd.Series) -> np.ndarray:
    """64 bits of each digest: the first eight bytes, shorter digests filled up."""
    return np.array([int.from_bytes(d[:8].ljust(8, b"\0"), "little") for d in digests], np.uint64)


def grouped(digests: DataFrame) -> DataFrame:
    """``(digest, n, last)``: rows and largest id of each digest; copies are folded before the exchange."""
    return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


def _filter_of(bucket: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": bucket["bucket"].iloc[:1], "filter": [fuse.build(_keys(bucket["digest"]))]})


def write_snapshot(digests: DataFrame) -> Snapshot:
    """Store ``(doc_id, digest)`` rows as exact buckets with their filters."""
    spark = digests.sparkSession
    folder = new_path(spark, "snapshot")
    n = max(1, -(-digests.count() // BUCKET))
    grouped(digests).withColumn("bucket", _bucket(n)).write.parquet(f"{folder}/buckets")
    keys = spark.read.parquet(f"{folder}/buckets").select("bucket", "digest")
    keys.groupBy("bucket").applyInPandas(_filter_of, "bucket int, filter binary").write.parquet(f"{folder}/filters")
    return Snapshot(folder, n)


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if batch.empty or filters.empty:
        return batch[["digest"]].iloc[:0]
    return batch[["digest"]][fuse.contains(filters["filter"].iloc[0], _keys(batch["digest"]))]


def stored_matches(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``(digest, n, last)`` of the snapshot for the batch's digests that it has."""
    spark = batch.sparkSession
    filters = spark.read.parquet(f"{snapshot.folder}/filters")
    positives = (
        batch.select("digest", _bucket(snapshot.buckets).alias("bucket"))
        .groupBy("bucket")
        .cogroup(filters.groupBy("bucket"))
        .applyInPandas(_screen, "digest binary")
    )
    return spark.read.parquet(f"{snapshot.folder}/buckets").select("digest", "n", "last").join(positives, "digest")


def _texts_differ(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``(digest,)`` of the groups whose texts are not all the same bytes."""
    texts = docs.select(whole_text().alias("text")).withColumn("digest", digest(F.col("text")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    several = groups.where("n > 1").select("digest", (F.col("n") * HOT_DIGESTS >= total).alias("hot"))
    hot = several.where("hot").select("digest")  # at most HOT_DIGESTS rows
    ends = [F.min("text").alias("least"), F.max("text").alias("most")]
    marked = texts.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    of_hot = marked.where("hot").groupBy("digest").agg(*ends)
    # these grow with the input, so they are not broadcast where they happen to be few
    of_rest = marked.where("hot is null").join(several.where("not hot").hint("merge"), "digest", "left_semi").groupBy("digest").agg(*ends)
    return of_hot.unionByName(of_rest).where("least <> most").select("digest")


def classes(docs: DataFrame, stored: Column | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)`` of every row of ``docs``.

    ``stored`` marks the rows that make up the snapshot; the others are the new batch (without it, all).
    """
    docs = docs.select("doc_id", "text", F.coalesce(stored if stored is not None else F.lit(False), F.lit(False)).alias("stored"))
    rows = written(docs.select("doc_id", "stored", digest(whole_text()).alias("digest")), "digests")
    snapshot = write_snapshot(rows.where("stored"))
    old = rows.sparkSession.read.parquet(f"{snapshot.folder}/buckets").select("digest", "n", "last")
    new = written(grouped(rows.where("not stored")), "batch-groups")
    found = written(stored_matches(new, snapshot), "matches")
    both = (
        new.join(found.select("digest", F.col("n").alias("old_n"), F.col("last").alias("old_last")), "digest", "left")
        .select("digest", (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.greatest("last", "old_last").alias("last"))
    )
    groups = written(both.unionByName(old.join(found, "digest", "left_anti")), "groups")
    clashes = written(_texts_differ(docs, groups, digest), "clashes")
    result = rows.join(groups, "digest").select("doc_id", "digest", F.col("last").alias("keep_id"), F.col("n").alias("group_size"))
    if not clashes.isEmpty():
        apart = docs.select("doc_id", whole_text().alias("text")).withColumn("digest", digest(F.col("text"))).join(clashes, "digest", "left_semi")
        by_text = apart.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        result = result.join(clashes, "digest", "left_anti").unionByName(
            apart.join(by_text, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
        )
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicated(docs: DataFrame, stored: Column | None = None) -> DataFrame:
    """The rows that stay, with all columns; of wholly repeated rows (same id, same text) one."""
    keys = ["__id", "__none", "__digest"]  # a null id is a key of its own
    named = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none")]
    stay = classes(docs, stored).where("kept").select(*named, F.col("digest").alias("__digest")).distinct()
    marked = docs.select("*", *named, sha256(whole_text(docs["text"])).alias("__digest"))
    return marked.join(stay, keys, "left_semi").dropDuplicates(keys).select(docs.columns)


def earlier_half(docs: DataFrame) -> Column:
    """Marks the rows with ids in the lower half of the range: what was there before the batch."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    return F.col("doc_id") < F.lit(None if low is None else (low + high) // 2)
