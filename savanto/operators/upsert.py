"""Write semantics of key/value and relational stores, as table rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_latest(old: DataFrame, new: DataFrame, key: Sequence[str], ts: str | Column) -> DataFrame:
    """Insert or overwrite by key: the latest row per key wins, as a map-side combinable aggregate."""
    rest = [c for c in old.columns if c not in key]
    rows = old.unionByName(new).groupBy(*key).agg(F.max_by(F.struct(*rest), ts).alias("r"))
    return rows.select(*[c if c in key else F.col(f"r.{c}").alias(c) for c in old.columns])


def upsert_partial(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite only the listed columns with their new non-null values; unknown keys are added.

    ``new`` has one row per key.
    """
    incoming = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = old.join(incoming, key, "full")
    return joined.select(
        *[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns]
    )


def merge_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Hash merge: every supplied (non-null) field overwrites, the others stay."""
    return upsert_partial(old, new, key, [c for c in new.columns if c != key and c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], order: str | Column | None = None) -> DataFrame:
    """Add rows with unseen keys; the existing row of a key stays, else its first one by ``order``."""
    if order is None:
        first = new.dropDuplicates(list(key))
    else:
        rest = [c for c in old.columns if c not in key]
        first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
    added = first.join(old.select(*key), list(key), "left_anti")
    return old.unionByName(added.select(*old.columns))


def new_row_count(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows an insert-ignore would add."""
    return (
        new.select(*key).distinct().join(old.select(*key), list(key), "left_anti").agg(F.count(F.lit(1)).alias("added"))
    )


def set_add(old: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent set insertion."""
    return old.unionByName(new).distinct()


def zset_last_wins(rows: DataFrame, key: Sequence[str], score: str, ts: str | Column) -> DataFrame:
    """Sorted-set semantics: the last score of each member."""
    return rows.groupBy(*key).agg(F.max_by(score, ts).alias(score))

