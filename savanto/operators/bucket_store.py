"""A stored table with a key, upserted by rewriting only the buckets that a delta touches.

Rows are dealt to hash buckets of the key. A manifest names the folder that holds each bucket; a change writes
new folders for the touched buckets and then publishes a manifest that names them, so a run that dies changes
nothing, and of two runs from the same manifest one fails. What no recent manifest names can be swept.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from savanto.operators.upsert import upsert_latest
from savanto.sources import manifest

_BUCKET = "__bucket"


@dataclass(frozen=True)
class BucketStore:
    """Where the table is, its key, and how many buckets it has."""

    path: str
    key: tuple[str, ...]
    buckets: int = 256

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Store dealt rows in a new folder; the part of it that each bucket got."""
        spark, part = rows.sparkSession, uuid.uuid4().hex
        place = f"{self.path}/data/{part}"
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(place)
        return {n.split("=")[1]: f"{part}/{n}" for n in manifest.names(spark, place) if n.startswith(f"{_BUCKET}=")}

    def _state(self, spark: SparkSession) -> tuple[int, dict]:
        found = manifest.latest(spark, f"{self.path}/manifest")
        if found is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return found

    def create(self, rows: DataFrame) -> None:
        """Store the first rows, which have each key once."""
        folders = self._write(self._dealt(rows))
        manifest.publish(rows.sparkSession, f"{self.path}/manifest", 1, {"schema": rows.schema.jsonValue(), "buckets": self.buckets, "folders": folders})

    def folders(self, spark: SparkSession, version: int | None = None) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        return self._content(spark, version)["folders"]

    def _content(self, spark: SparkSession, version: int | None) -> dict:
        return self._state(spark)[1] if version is None else manifest.read(spark, f"{self.path}/manifest", version)

    def _open(self, spark: SparkSession, content: dict, only: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(content["schema"])
        chosen = [f for b, f in sorted(content["folders"].items()) if only is None or b in set(only)]
        if not chosen:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in chosen]).select(schema.names)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an earlier one."""
        return self._open(spark, self._content(spark, version))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of a few keys, from their buckets only."""
        spark = keys.sparkSession
        content = self._state(spark)[1]
        return self._open(spark, content, self._touched(self._dealt(keys.select(*self.key)))).join(keys.select(*self.key).distinct(), list(self.key), "left_semi")

    @staticmethod
    def _touched(dealt: DataFrame) -> list[str]:
        """No more than the table has buckets."""
        return [str(r[0]) for r in dealt.select(_BUCKET).distinct().collect()]

    def upsert(self, delta: DataFrame, ts: str | Column) -> list[str]:
        """Insert or overwrite by key, the latest row of a key wins; the buckets that were written."""
        spark = delta.sparkSession
        number, content = self._state(spark)
        if content["buckets"] != self.buckets:
            raise ValueError(f"the table has {content['buckets']} buckets")
        touched = self._touched(self._dealt(delta))
        if not touched:
            return []
        old = self._open(spark, content, touched)
        written = self._write(self._dealt(upsert_latest(old, delta.select(old.columns), list(self.key), ts)))
        manifest.publish(spark, f"{self.path}/manifest", number + 1, content | {"folders": content["folders"] | written})
        return touched

    def sweep(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Remove the folders that none of the newest ``keep`` versions names, and the older versions."""
        place = f"{self.path}/manifest"
        numbers = manifest.versions(spark, place)
        named = {f for n in numbers[-keep:] for f in manifest.read(spark, place, n)["folders"].values()}
        for n in numbers[:-keep]:
            manifest.remove(spark, f"{place}/{n:012d}.json")
        gone = []
        for part in manifest.names(spark, f"{self.path}/data"):
            for bucket in manifest.names(spark, f"{self.path}/data/{part}"):
                if bucket.startswith(f"{_BUCKET}=") and f"{part}/{bucket}" not in named:
                    manifest.remove(spark, f"{self.path}/data/{part}/{bucket}")
                    gone.append(f"{part}/{bucket}")
        return gone
