"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the table's slots, made from a start and a step. The shards take turns,
and at each turn a shard claims the first slot of its permutation that is still free, until the table is
full. A row's slot is a hash of its key modulo the table's prime size, so placement is one look into a
table of fixed size. Shares differ by one slot at most, and few keys move when a shard comes or goes.

A null key is placed like the empty string; equal keys go to one shard; an empty table gives an empty
result. All columns of the input stay; ``slot`` and ``shard`` are replaced where the input has them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Slots of a table, at most; the table is broadcast.
MOST_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def number(text: str) -> int:
    """The first eight hexadecimal digits of the MD5 digest."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup(shards: Sequence[str], size: int) -> list[int]:
    """For each slot, the position in ``shards`` of the shard that has it. Names must differ."""
    if not (is_prime(size) and len(shards) <= size <= MOST_SLOTS) or not shards or len(set(shards)) < len(shards):
        raise ValueError("the table needs a prime number of slots, not fewer than shards, and distinct names")
    starts = [number(f"start {s}") % size for s in shards]
    steps = [number(f"step {s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner = [-1] * size
    at, left = list(starts), size
    while left:
        for i, step in enumerate(steps):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def lookup_frame(spark: SparkSession, shards: Sequence[str], size: int) -> DataFrame:
    """``(slot, shard)``, one row for each slot."""
    owners = F.from_json(F.lit(json.dumps(lookup(shards, size))), "array<int>")
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.element_at(names, F.col("owner") + 1).alias("shard"))


def slot(key: Column, size: int) -> Column:
    """Hash of a key, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(rows: DataFrame, key: str, shards: Sequence[str], size: int) -> DataFrame:
    """All columns of ``rows`` with their ``slot`` and ``shard``."""
    table = lookup_frame(rows.sparkSession, shards, size)
    keyed = rows.drop("slot", "shard").withColumn("slot", slot(F.col(key), size))
    return keyed.join(F.broadcast(table), "slot").select(*[c for c in keyed.columns if c != "slot"], "slot", "shard")


def write_shards(rows: DataFrame, key: str, shards: Sequence[str], size: int, folder: str) -> None:
    """One folder for each shard. A shard may be larger than a task: its rows stay in the partitions they are in."""
    place(rows, key, shards, size).write.partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, columns: StructType) -> DataFrame:
    """The rows of all shards, as :func:`write_shards` wrote them; ``columns`` are those of its ``rows``."""
    kept = [c for c in columns.fields if c.name not in ("slot", "shard")]
    return spark.read.schema(StructType([*kept, StructField("slot", IntegerType()), StructField("shard", StringType())])).parquet(folder)
