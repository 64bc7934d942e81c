"""Small numbered JSON files that name what a stored table consists of.

A version is written beside its place and renamed to it, and a number is given once: of two writers that
start from the same version one fails. Readers take the highest number, so they see all of a change or nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _context(spark: SparkSession, folder: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place = place.getFileSystem(conf).makeQualified(place)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf), place


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder; none where it does not exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(conf)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def remove(spark: SparkSession, folder: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(conf).delete(place, True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    return sorted(int(n[: -len(".json")]) for n in names(spark, folder) if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, folder: str, number: int) -> dict:
    jvm, context, place = _context(spark, folder)
    stream = context.open(jvm.org.apache.hadoop.fs.Path(place, f"{number:012d}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def latest(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The newest version and its number."""
    found = versions(spark, folder)
    return (found[-1], read(spark, folder, found[-1])) if found else None


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> None:
    """Make ``content`` version ``number``; fails if there is one by that number."""
    jvm, context, place = _context(spark, folder)
    path = jvm.org.apache.hadoop.fs.Path
    draft, final = path(place, f".{uuid.uuid4().hex}.draft"), path(place, f"{number:012d}.json")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(draft, final, options)
    except Exception:
        system.delete(draft, False)
        raise
