"""A stored order of rows in which any page is found by its offset.

The rows are sorted once into ranges, each a folder with a place column; a manifest has the rows of every range.
A page opens the ranges that its offsets fall into, one or two of them, and within these the places are in the
scan's filters. A page is found without ranking, counting or reading what comes before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from savanto.session import written
from savanto.sources import manifest

#: Rows of a range, about.
RANGE_ROWS = 1_000_000
_PLACE, _RANGE = "__place", "__range"


def _place_in_range() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


@dataclass(frozen=True)
class StoredOrder:
    """Where the rows are."""

    path: str

    @staticmethod
    def build(df: DataFrame, order: Sequence[Column], path: str, range_rows: int = RANGE_ROWS) -> StoredOrder:
        """Store ``df`` in a total order (it must end in a unique column)."""
        spark = df.sparkSession
        rows = written(df, "to-order")
        n = max(1, -(-rows.count() // range_rows))
        # one range of the sort is one task and one folder; its rows keep their places in it
        ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        placed = ranged.withColumn(_PLACE, _place_in_range()).withColumn(_RANGE, F.spark_partition_id())
        placed.write.partitionBy(_RANGE).parquet(f"{path}/rows")
        # one number for each range
        sizes = {r[_RANGE]: r["n"] for r in spark.read.parquet(f"{path}/rows").groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n")).collect()} if rows.head(1) else {}
        manifest.publish(spark, f"{path}/manifest", 1, {"schema": df.schema.jsonValue(), "ranges": sorted(sizes.items())})
        return StoredOrder(path)

    def _content(self, spark: SparkSession) -> dict:
        found = manifest.latest(spark, f"{self.path}/manifest")
        if found is None:
            raise FileNotFoundError(f"no stored order at {self.path}")
        return found[1]

    def total(self, spark: SparkSession) -> int:
        """All rows, whatever the page size."""
        return sum(n for _, n in self._content(spark)["ranges"])

    def page(self, spark: SparkSession, offset: int, size: int) -> DataFrame:
        """The rows from ``offset`` (from 0) on, ``size`` of them at most, in order."""
        content = self._content(spark)
        schema = StructType.fromJson(content["schema"])
        stored = StructType([*schema.fields, StructField(_PLACE, LongType())])
        parts, end = [], 0
        for number, n in content["ranges"]:
            start, end = end, end + n
            low, high = max(offset, start), min(offset + size, end)
            if low < high:
                rows = spark.read.schema(stored).parquet(f"{self.path}/rows/{_RANGE}={number}")
                inside = rows.where((F.col(_PLACE) >= low - start) & (F.col(_PLACE) < high - start))
                parts.append(inside.withColumn(_PLACE, F.col(_PLACE) + start))
        if not parts:
            return spark.createDataFrame([], schema)
        # a page is what is shown at once: its order is made again over its own rows
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return union.orderBy(_PLACE).select(schema.names)
