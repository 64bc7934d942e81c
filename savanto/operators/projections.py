"""Allow-listed projections between record fields and network-prefixed columns, and key filters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savanto.functions import text as tx

# The fields kept per network, with the prefix of their columns.
KEPT_FIELDS = {
    "twitter_": ["id", "name", "screen_name", "description", "profile_image_url", "location", "listed_count",
                 "created_at", "verified"],
    "so_": ["id", "account_id", "user_id", "display_name", "profile_image", "location", "reputation", "url", "link",
            "creation_date"],
    "q_": ["name", "profile_image_url", "num_views", "short_description", "num_answers"],
}


def project_prefixed(records: DataFrame, prefix: str, now: Column) -> DataFrame:
    """Kept fields that the records have, prefixed, plus the crawl time; nested and other fields go."""
    have = set(records.columns)
    kept = [F.col(f).alias(prefix + f) for f in KEPT_FIELDS[prefix] if f in have]
    return records.select(*kept, now.alias(prefix + "last_crawled"))


def project_unprefixed(rows: DataFrame, prefix: str) -> DataFrame:
    """All columns of one network with the prefix removed."""
    return rows.select(*[F.col(c).alias(c[len(prefix) :]) for c in rows.columns if c.startswith(prefix)])


def project_tags(tags: DataFrame) -> DataFrame:
    return tags.select("name", "count", "site")


def key_matches(key: Column, contains: str = "", prefix: str = "", not_prefix: Sequence[str] = ()) -> Column:
    """Key test by literal substring, prefix and excluded prefixes (no wildcard of the input is live)."""
    test = F.lit(True)
    if contains:
        test &= key.like("%" + tx.like_literal(contains) + "%")
    if prefix:
        test &= key.startswith(prefix)
    for p in not_prefix:
        test &= ~key.startswith(p)
    return test


def batch_lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids (a semi join, never a literal list)."""
    return rows.join(ids.select(key), key, "left_semi")


def point_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of one (unique) key. A missing key raises when the result is evaluated."""
    found = rows.where(F.col(key) == F.lit(value)).agg(F.max(F.struct(*rows.columns)).alias("r"))
    missing = F.raise_error(F.lit(f"no row with {key} = {value}")).cast("boolean")
    return found.where(F.when(F.col("r").isNotNull(), F.lit(True)).otherwise(missing)).select("r.*")


@dataclass(frozen=True)
class Field:
    """A declared field: its name, the (dotted) source it is taken from, a conversion, and, for a list of
    records, the fields of each."""

    name: str
    source: str | None = None
    convert: Callable[[Column], Column] | None = None
    many: tuple[Field, ...] = ()

    def of(self, record: Callable[[str], Column]) -> Column:
        value = record(self.source or self.name)
        if self.many:
            value = F.transform(value, lambda item: F.struct(*[f.of(lambda path: item.getField(path)) for f in self.many]))
        return (self.convert(value) if self.convert else value).alias(self.name)


def declared(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """The declared fields of every row: renamed, converted, and lists of records field by field."""
    return rows.select(*[f.of(F.col) for f in fields])
