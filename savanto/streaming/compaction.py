"""Delta tables of a stream that stay small: a snapshot, and the deltas written after it.

Every micro-batch writes one folder. From time to time the folders of finished batches and the snapshot before
are reduced to a new snapshot, and a numbered pointer is published that names it with the last batch it holds.
A reader opens that snapshot and the later folders only, so it never opens more than ``every`` folders and two.
A stop at any point leaves the old pointer valid; a batch that is tried again overwrites its own folder, which
no snapshot holds yet. Folders that both the newest and the former pointer have passed are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from savanto.sources import manifest

#: Column with the number of the micro-batch a row came from.
BATCH = "batch"


@dataclass(frozen=True)
class Deltas:
    """A delta table; ``reduce`` folds rows (with their ``batch``) to those a reader needs, and folding the
    folded rows with later ones must give what folding all of them gives."""

    path: str
    schema: StructType
    reduce: Callable[[DataFrame], DataFrame]
    every: int = 8

    def write(self, rows: DataFrame, batch: int) -> None:
        """The folder of one micro-batch, reduced; then a compaction, if it is time."""
        numbered = rows.select(self.schema.names).withColumn(BATCH, F.lit(batch).cast("bigint"))
        self.reduce(numbered).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch:012d}")
        if batch % self.every == self.every - 1:
            self.compact(rows.sparkSession, batch - 1)

    def _pointer(self, spark: SparkSession) -> tuple[int, dict]:
        return manifest.latest(spark, f"{self.path}/pointer") or (0, {"snapshot": None, "upto": -1})

    def folders(self, spark: SparkSession, upto: int | None = None) -> list[str]:
        """What a reader opens: the snapshot and the deltas after it (to batch ``upto``)."""
        pointer = self._pointer(spark)[1]
        later = sorted(int(n) for n in manifest.names(spark, f"{self.path}/deltas") if n.isdigit())
        deltas = [f"{self.path}/deltas/{n:012d}" for n in later if n > pointer["upto"] and (upto is None or n <= upto)]
        return ([f"{self.path}/snapshots/{pointer['snapshot']}"] if pointer["snapshot"] else []) + deltas

    def _open(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(BATCH, LongType())])
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """The folded rows of all batches so far."""
        return self.reduce(self._open(spark, self.folders(spark)))

    def compact(self, spark: SparkSession, upto: int) -> bool:
        """Fold everything to batch ``upto``, which must be finished, into a new snapshot; whether there was any."""
        number, pointer = self._pointer(spark)
        folders = self.folders(spark, upto)
        if upto <= pointer["upto"] or not folders:
            return False
        name = uuid.uuid4().hex
        self.reduce(self._open(spark, folders)).write.parquet(f"{self.path}/snapshots/{name}")
        manifest.publish(spark, f"{self.path}/pointer", number + 1, {"snapshot": name, "upto": upto})
        self.sweep(spark)
        return True

    def sweep(self, spark: SparkSession) -> None:
        """Remove deltas, snapshots and pointers that neither of the two newest pointers needs."""
        numbers = manifest.versions(spark, f"{self.path}/pointer")[-2:]
        kept = [manifest.read(spark, f"{self.path}/pointer", n) for n in numbers]
        passed = kept[0]["upto"] if len(kept) == 2 else -1
        for n in manifest.names(spark, f"{self.path}/deltas"):
            if n.isdigit() and int(n) <= passed:
                manifest.remove(spark, f"{self.path}/deltas/{n}")
        for n in manifest.names(spark, f"{self.path}/snapshots"):
            if n not in {p["snapshot"] for p in kept}:
                manifest.remove(spark, f"{self.path}/snapshots/{n}")
        for n in manifest.versions(spark, f"{self.path}/pointer")[:-2]:
            manifest.remove(spark, f"{self.path}/pointer/{n:012d}.json")
