"""Stored positional postings, and the first documents of a search from few of them.

Offline, documents are dealt to blocks of about equal length and each term of a document becomes one posting:
(term, document, positions). Postings lie in folders by a hash of the term, sorted by term and block, so that a
search opens the folders of its terms and skips the rest of their files by the terms' ranges. A second table has
one row for each term of a block: how many documents hold it, and how often one of them does at most.

A search takes blocks in the order of the best document they could hold: the level is the number of query terms
that the block has; of the hits of a document each starts one cover at most, and a cover of i terms is i tokens
long at least. After some blocks are scored exactly, those that cannot reach the last kept place of their query
are left unread. The result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savanto.functions import text as tx
from savanto.operators import cover
from savanto.session import written

#: Documents of a block, about, and folders of the postings.
BLOCK_DOCS, FOLDERS = 1024, 64
#: Distinct terms of a batch of queries that are written into the plan; beyond, the join alone selects.
LISTED_TERMS = 1000
#: Tasks that share a block's documents, and those that write a folder.
SPREAD = 8
#: Bytes of text whose postings a task makes at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 22
#: Documents that the first blocks of a query hold for each one kept; each round takes so many times more.
MARGIN, FACTOR = 2, 4


@dataclass(frozen=True)
class Index:
    """Folders of the postings and of the block summaries; the documents' key column."""

    path: str
    key: str = "doc_id"
    kind: str = "bigint"
    folders: int = FOLDERS

    def postings(self, spark: SparkSession) -> DataFrame:
        schema = f"term string, block string, `{self.key}` {self.kind}, positions array<int>, folder int"
        return spark.read.schema(schema).parquet(f"{self.path}/postings")

    def summaries(self, spark: SparkSession) -> DataFrame:
        schema = "term string, block string, docs bigint, most int, folder int"
        return spark.read.schema(schema).parquet(f"{self.path}/summaries")


def folder_of(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about ``SLICE_BYTES`` of text."""
    before = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = before[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(before, done + SLICE_BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, documents, positions) of rows (document, block, text): a document's tokens are put together
    where its text is, and the documents of a block that come together share a row."""
    for batch in (part for whole in batches for part in _slices(whole)):
        split = pc.split_pattern(batch.column("text"), " ")
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        blocks = batch.column("block").dictionary_encode()
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code += np.repeat(blocks.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes) * len(words.dictionary)
        kept = np.flatnonzero(pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False)[code % max(1, len(words.dictionary))])
        kept = kept[np.argsort(code[kept], kind="stable")]  # rows and positions stay in order
        row, pos, code = row[kept], pos[kept], code[kept]
        new = np.diff(code, prepend=-1) != 0
        docs = np.flatnonzero(new | (np.diff(row, prepend=-1) != 0))
        heads = np.flatnonzero(new)
        positions = pa.ListArray.from_arrays(pa.array(np.append(docs, len(row)), pa.int32()), pa.array(pos, pa.int32()))
        of_head = pa.array(np.append(np.searchsorted(docs, heads), len(docs)), pa.int32())
        term, block = (pa.array(x) for x in np.divmod(code[heads], max(1, len(words.dictionary)))[::-1])
        keys = batch.column(0).take(pa.array(row[docs]))
        columns = [words.dictionary.take(term), blocks.dictionary.take(block), pa.ListArray.from_arrays(of_head, keys), pa.ListArray.from_arrays(of_head, positions)]
        yield pa.RecordBatch.from_arrays(columns, ["term", "block", "keys", "positions"])


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", folders: int = FOLDERS, block_docs: int = BLOCK_DOCS) -> Index:
    """Store the postings of all documents; a missing text has no terms. ``key`` is unique; rows that share one are
    searched as one document, and bounds are as many times larger."""
    # what is taken out of a text are never blanks, so they count its tokens
    blanks = F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))
    counted = docs.select(key, text, F.coalesce(blanks + 1, F.lit(0)).alias("n"))
    # documents of about equal length share a block, so that the bounds of a block are near to what it holds
    length = F.floor(F.log2(F.greatest("n", F.lit(1))) * 2).cast("int")
    per_length = counted.groupBy(length.alias("length")).agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("int").alias("blocks"))
    # one row for each half power of two of a text's length
    blocked = counted.withColumn("length", length).join(F.broadcast(per_length), "length")
    block = F.concat_ws(":", "length", F.pmod(F.xxhash64(key), F.col("blocks")))
    kind = docs.schema[key].dataType.simpleString()
    cleaned = blocked.where(F.col(text).isNotNull()).select(key, block.alias("block"), tx.blank_cleaned(F.col(text)).alias("text"))
    # whole texts are exchanged, so that a block's documents come together; several tasks share a block
    together = cleaned.repartition("block", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(SPREAD))).sortWithinPartitions("block")
    postings = together.mapInArrow(_postings, f"term string, block string, keys array<{kind}>, positions array<array<int>>")
    stored = postings.withColumn("folder", folder_of(F.col("term"), folders))
    # a folder is written by several tasks: a common term's postings are spread by block
    spread = F.pmod(F.xxhash64("block"), F.lit(SPREAD))
    placed = stored.repartition("folder", spread).sortWithinPartitions("folder", "term", "block")
    # a row for each document is made after the sort
    single = placed.select("folder", "term", "block", F.inline(F.arrays_zip(F.col("keys").alias(key), F.col("positions"))))
    single.select("term", "block", key, "positions", "folder").write.partitionBy("folder").parquet(f"{path}/postings")
    index = Index(path, key, kind, folders)
    most_rows = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    bounds = index.postings(docs.sparkSession).groupBy("folder", "term", "block").agg(
        F.count(F.lit(1)).alias("docs"), (F.max(F.size("positions")) * F.lit(most_rows)).cast("int").alias("most")
    )
    bounds.repartition("folder", spread).sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/summaries")
    return index


def of_terms(stored: DataFrame, terms: DataFrame, folders: int) -> DataFrame:
    """The rows of the queries' terms with ``query_id`` and ``slot``; folders and terms are in the scan's filters."""
    listed = [r["term"] for r in terms.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
    if len(listed) <= LISTED_TERMS:
        numbers = terms.select(folder_of(F.col("term"), folders).alias("f")).distinct().collect()
        stored = stored.where(F.col("folder").isin([r["f"] for r in numbers]) & F.col("term").isin(listed))
    return stored.join(terms.select("query_id", "slot", "term", folder_of(F.col("term"), folders).alias("folder")), ["folder", "term"])


def bounded_blocks(index: Index, terms: DataFrame) -> DataFrame:
    """``(query_id, block, level, score, docs, before)``: what a block's best document may reach, and the
    documents of the blocks that may hold better ones."""
    found = of_terms(index.summaries(terms.sparkSession), terms, index.folders)
    level = F.count(F.lit(1))
    shortest = F.least(F.lit(1.0), F.lit(cover.KAPPA) / level)
    # covers of all the terms start at different hits, and the last ones of the other terms start none
    best = found.groupBy("query_id", "block").agg(
        level.cast("int").alias("level"), ((F.sum("most") - level + 1) * shortest).alias("score"), F.max("docs").alias("docs")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("level"), F.desc("score"), "block")
    return written(best.withColumn("before", F.sum("docs").over(order) - F.col("docs")), "block-bounds")


def scored(index: Index, terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(query_id, doc, level, score)`` of the matching documents of ``(query_id, block)``."""
    found = of_terms(index.postings(terms.sparkSession), terms, index.folders).join(blocks.select("query_id", "block"), ["query_id", "block"])
    slots = F.transform("positions", lambda p: F.struct(p.cast("int").alias("pos"), F.col("slot").cast("int").alias("slot")))
    of_doc = found.groupBy("query_id", index.key).agg(F.array_sort(F.flatten(F.collect_list(slots))).alias("hits"))
    return cover.top_level_of(of_doc, [index.key])


def search(index: Index, queries: DataFrame, limit: int = cover.KEPT_DOCUMENTS) -> DataFrame:
    """``(query_id, doc, level, score, rank)``: the first ``limit`` documents of every query."""
    return _searched(index, queries, limit)[0]


def _searched(index: Index, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The result, and ``(query_id, block)`` of the blocks that were read for it."""
    terms = written(cover.query_terms(queries), "query-terms")
    bounds = bounded_blocks(index, terms)
    reach = limit * MARGIN
    chosen = bounds.where(F.col("before") < reach)
    best, read = None, None
    while True:
        chosen = written(chosen, "blocks-read")
        now = scored(index, terms, chosen)
        kept = cover.keep_ranked(now if best is None else now.unionByName(best), ["query_id"], index.key, limit)
        best = written(kept.drop("rank"), "best-so-far")
        read = chosen if read is None else read.unionByName(chosen)
        # the last kept place of a query that has enough documents
        last = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("level", "score")).alias("last")).where(F.col("n") >= limit)
        left = bounds.where(F.col("before") >= reach).join(last.select("query_id", "last"), "query_id", "left")
        hopeful = F.col("last").isNull() | (F.col("level") > F.col("last.level")) | ((F.col("level") == F.col("last.level")) & (F.col("score") >= F.col("last.score") - 10.0**-cover.DIGITS))
        left = left.where(hopeful).drop("last")
        nearest = left.agg(F.min("before")).first()[0]
        if nearest is None:
            return cover.keep_ranked(best, ["query_id"], index.key, limit), read.select("query_id", "block")
        further = max(reach * FACTOR, nearest + 1)
        chosen, reach = left.where(F.col("before") < further), further
