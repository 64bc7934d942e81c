"""Line deduplication by winnowing.

The lines of a text that are not blank, trimmed, form a sequence. A run of ``Runs.lines`` consecutive lines
that stood earlier in the corpus is deleted; so is a single line of ``Runs.words`` words or more that did.
Earlier means a smaller id, then (for rows that share an id) a smaller digest of the text, then an earlier
line. Ids must be numbers.

A line of ``Runs.words`` words or more is a window, and a fingerprint, of its own. Of every window of
``Runs.lines`` line hashes the least one is selected as its fingerprint, so every run contains one. Selected lines are posted with their positions and counted over the corpus; those that occur
twice are joined with their positions again and extended both ways, to the windows whose least line they are.
Of equal windows the first position is a minimum that is combined before the exchange, and all later ones are
deleted; a longer match is extended from one selected line to the next, by windows that overlap. A very
frequent line therefore costs one small row for each occurrence, never a pair. The plan is the same at every
size: joins are sorted, and texts are exchanged once.

Null texts count as empty; very long ones are cut into lines like any other. Wholly repeated rows (same id, same text) count as one document, and each of
them is returned. Blank lines between deleted lines of a run go with it. An empty table gives an empty
result. All other columns are kept; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savanto.llm.common import slices, whole_text
from savanto.session import written

#: Characters trimmed from a line's ends.
TRIMMED = " \t\r"


@dataclass(frozen=True)
class Runs:
    """What is deleted: runs of this many lines, and single lines of this many words."""

    lines: int = 2
    words: int = 5


def fingerprints_of(text: str, runs: Runs) -> list[tuple[int, int, int, bytes]]:
    """``(fingerprint, first line, last line, digest)`` of each run of a text, under its least line hash;
    line numbers count all lines from 0. Long lines are runs of their own."""
    kept = [(i, s) for i, line in enumerate(text.split("\n")) if (s := line.strip(TRIMMED))]
    raw = [s.encode("utf-8", "surrogatepass") for _, s in kept]
    hashes = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
    digests = [xxhash.xxh3_128_digest(r) for r in raw]
    found = [(int(hashes[j]), i, i, digests[j]) for j, (i, s) in enumerate(kept) if s.count(" ") + 1 >= runs.words]
    if len(kept) >= runs.lines:
        least = np.lib.stride_tricks.sliding_window_view(hashes, runs.lines).min(axis=1)
        found += [
            (int(least[j]), kept[j][0], kept[j + runs.lines - 1][0], xxhash.xxh3_128_digest(b"".join(digests[j : j + runs.lines]) + b"run"))
            for j in range(len(least))
        ]
    return found


def _runs(docs: DataFrame, runs: Runs) -> DataFrame:
    """``(doc, fingerprint, runs)``: every fingerprint of a document with the runs that are under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("digest", pa.binary())]))
        for batch in batches:
            for part in slices(batch):
                docs_, prints, lists = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    by: dict[int, list] = {}
                    for fingerprint, first, last, digest in fingerprints_of(text, runs):
                        by.setdefault(fingerprint, []).append((first, last, digest))
                    docs_ += [i] * len(by)
                    prints += by.keys()
                    lists += by.values()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(docs_, pa.int64())), pa.array(prints, pa.int64()), pa.array([[dict(zip(("first", "last", "digest"), r, strict=True)) for r in x] for x in lists], kind)],
                    ["doc", "fingerprint", "runs"],
                )

    rows = docs.select(_key(docs["doc_id"], docs["text"]).alias("doc"), whole_text(docs["text"]).alias("text"))
    return rows.mapInArrow(run, "doc struct<id:bigint,text:bigint>, fingerprint bigint, runs array<struct<first:int,last:int,digest:binary>>")


def _key(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.cast("long").alias("id"), F.xxhash64(whole_text(text)).alias("text"))


def repeated(docs: DataFrame, runs: Runs = Runs()) -> DataFrame:  # noqa: B008
    """``(doc, spans)``: the spans of lines ``(first, last)`` of each document that stood earlier."""
    posted = written(_runs(docs, runs), "line-fingerprints")
    # a fingerprint may be repeated within one document: count its runs
    often = posted.groupBy("fingerprint").agg(F.sum(F.size("runs")).alias("n")).where("n > 1").select("fingerprint")
    found = posted.join(often.hint("merge"), "fingerprint").select("doc", F.explode("runs").alias("r")).select("doc", "r.*")
    place = F.struct("doc.id", "doc.text", "first")
    met = written(found.withColumn("place", place), "line-runs")
    firsts = met.groupBy("digest").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = met.join(firsts.hint("merge"), "digest").where(~F.col("place").eqNullSafe(F.col("earliest")))
    return later.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def deduplicated(docs: DataFrame, runs: Runs = Runs()) -> DataFrame:  # noqa: B008
    """All rows with ``clean_text`` (the lines left), ``n_lines`` and ``n_removed`` (lines that are not blank)."""
    spans = written(repeated(docs, runs), "line-spans")
    kept = docs.drop("clean_text", "n_lines", "n_removed")
    key = _key(kept["doc_id"], kept["text"])
    marked = kept.withColumn("__id", F.coalesce(key["id"], F.lit(0))).withColumn("__none", key["id"].isNull()).withColumn("__text", key["text"])
    named = spans.select(F.coalesce("doc.id", F.lit(0)).alias("__id"), F.col("doc.id").isNull().alias("__none"), F.col("doc.text").alias("__text"), F.col("spans").alias("__spans"))
    joined = marked.join(named.hint("merge"), ["__id", "__none", "__text"], "left").withColumn("__lines", F.split(whole_text(), "\n", -1))
    filled = lambda line: F.trim(line, F.lit(TRIMMED)) != ""
    inside = lambda i: F.exists("__spans", lambda s: (s["first"] <= i) & (i <= s["last"]))
    left = F.when(F.col("__spans").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda line, i: ~inside(i)))
    n_lines = F.size(F.filter("__lines", filled))
    return joined.withColumn("__left", left).select(
        *kept.columns, F.array_join("__left", "\n").alias("clean_text"), n_lines.cast("long").alias("n_lines"),
        (n_lines - F.size(F.filter("__left", filled))).cast("long").alias("n_removed"),
    )
