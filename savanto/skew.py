"""Building blocks that keep every task bounded when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savanto.session import written

BROADCAST_BYTES = 8 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the rows, written out, are no larger than ``max_bytes``.

    For cheap inputs (a batch of queries, a seed list). A larger side gets a shuffled, skew-split join, also where
    its file is so well compressed that Spark would broadcast it.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("size")).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df.hint("merge")


def hot_keys(df: DataFrame, key: str, target: int) -> DataFrame:
    """``(key, n_salts)`` for keys with more than ``target`` rows: at most rows/target of them."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > target).select(
        key, F.ceil(F.col("n") / F.lit(target)).cast("int").alias("n_salts")
    )


def salt_rows(df: DataFrame, hot: DataFrame, key: str, spread: str) -> DataFrame:
    """Add ``salt``: 0 for ordinary keys, spread over ``n_salts`` values for hot ones."""
    return (
        df.join(hot, key, "left")
        .withColumn(
            "salt",
            F.when(
                F.col("n_salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("n_salts")).cast("int")
            ).otherwise(F.lit(0)),
        )
        .drop("n_salts")
    )


def replicate_for_salts(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """The matching side of :func:`salt_rows`: hot keys once per salt, all others once."""
    return (
        df.join(hot, key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1)))
        .drop("n_salts")
    )


def adjacent_pairs(
    rows: DataFrame, key: str, order: str, first: str, last: str, bits: int = 21, order_bits: int = 63
) -> DataFrame:
    """``(key, last, next_first)`` for neighbouring rows of each key, ordered by a non-negative long.

    A plain ``lead`` would sort a whole key in one task. Here the order column is cut into
    blocks of ``2**bits`` values; neighbours inside a block are found first, then each block
    is reduced to its two ends and the ends are paired one level up. ``(key, order)`` must be
    unique, so no window ever sees more than ``2**bits`` rows. Order values need ``order_bits`` bits.
    """
    levels = -(-order_bits // bits)
    level = rows.select(key, F.col(order).cast("long").alias("o"), F.col(first).alias("f"), F.col(last).alias("l"))
    found = []
    for _ in range(levels):
        # one exchange feeds both the window and the reduction
        level = level.withColumn("g", F.shiftright("o", bits)).repartition(key, "g")
        ahead = F.lead("f").over(Window.partitionBy(key, "g").orderBy("o"))
        found.append(
            level.select(key, F.col("l").alias("last"), ahead.alias("next_first")).where(
                F.col("next_first").isNotNull()
            )
        )
        level = level.groupBy(key, F.col("g").alias("g")).agg(
            F.min_by("f", "o").alias("f"), F.max_by("l", "o").alias("l")
        ).withColumnRenamed("g", "o")
    return reduce(DataFrame.unionByName, found)


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """1-based position of every row in a total order, without a single-task window.

    One range shuffle sorts the rows; each row takes its place inside its own range and the
    ranges' sizes (one row per range) give the offset. ``order`` must end in a unique column.
    """
    ranged = written(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn("__part", part)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # sizes has one row per range partition, never more than the shuffle has partitions
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        ranged.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + place + 1)
        .drop("__part", "__id", "__offset")
    )
