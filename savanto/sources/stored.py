"""Edge lists, JSON records, JDBC profiles and sorted Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILES = (
    "user_id bigint, screen_name string, name string, description string, verified boolean, "
    "profile_image_url string, listed_count bigint, location string, created_at timestamp, last_crawled timestamp"
)


def read_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``follower followee`` text lines, any number of files; lines that do not parse are dropped."""
    lines = spark.read.csv(path, sep=" ", schema="follower string, followee string", mode="PERMISSIVE")
    typed = lines.select(*[F.trim(c).try_cast("bigint").alias(c) for c in ("follower", "followee")])
    return typed.where(F.col("follower").isNotNull() & F.col("followee").isNotNull())


def write_edges(edges: DataFrame, path: str, mode: str = "append") -> None:
    """Append edges as text lines."""
    edges.select("follower", "followee").write.mode(mode).csv(path, sep=" ")


def append_edges(edges: DataFrame, path: str) -> None:
    """Append edges to a Parquet table."""
    edges.select("follower", "followee").write.mode("append").parquet(path)


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Fetched records landed as JSON lines: ``(good rows, unparsable lines)``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json("value", f"{schema}, _bad string", options)
    rows = spark.read.text(path).select(parsed.alias("r")).select("r.*")
    return rows.where(F.col("_bad").isNull()).drop("_bad"), rows.where(F.col("_bad").isNotNull()).select("_bad")


def read_profiles(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Stored profiles; only the asked columns are read."""
    df = spark.read.schema(PROFILES).parquet(path)
    return df.select(*columns) if columns else df


def read_table_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options
) -> DataFrame:
    """A relational table in parallel id ranges (needs the database's driver on the class path)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high,
                 numPartitions=partitions, **options)
        .load()
    )


def id_page(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """One id range; the bounds reach the scan."""
    return df.where(F.col(key).between(low, high))


def write_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Write in key ranges, sorted inside, so that scans for a key skip files and row groups."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def site_dimension(sites: DataFrame) -> DataFrame:
    """``(name, domain)`` of the known sites, one domain per name (the first in order)."""
    return sites.groupBy("name").agg(F.min("domain").alias("domain"))


def seed_dimension(df: DataFrame, key: str, handles: str) -> DataFrame:
    """One row per site and seed handle from a site table with an array of handles."""
    return df.select(key, F.explode(handles).alias("handle"))


def distinct_handles(df: DataFrame, handle: str = "handle") -> DataFrame:
    """A handle list without its repeats."""
    return df.select(handle).dropDuplicates([handle])
