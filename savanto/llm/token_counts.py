"""Token counts with a digest cache.

The cache is a Parquet table of (content digest, tokeniser digest, count). Content digests join it;
only distinct texts that it lacks are encoded, and their counts are appended. A run that dies leaves
no half-written counts (Spark commits the append), and repeated entries of parallel runs are folded.

Null texts count as empty (0 tokens), empty texts give 0, repeated rows give a row each, an empty
table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savanto.llm import vocabulary
from savanto.llm.common import slices, whole_text

CACHE = "content binary, n_tokens bigint, tokenizer string"


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table is made where there is none."""
    spark.createDataFrame([], CACHE).write.mode("ignore").partitionBy("tokenizer").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, content)`` of every row; content is the SHA-256 of the text's bytes."""
    whole = whole_text(docs[text])
    return docs.select(
        docs[doc_id].alias("doc_id"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("content"),
    )


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.library_encoder(path)
        for batch in batches:
            for part in slices(batch):
                _, ends = encoder.flat(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(np.diff(ends), pa.int64())], ["content", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every row, as the tokeniser file's library counts them.

    ``cache`` is the folder of the stored counts; counts of other tokeniser files in it are not used.
    """
    spark = docs.sparkSession
    version = vocabulary.version(tokenizer)
    known = open_cache(spark, cache).where(F.col("tokenizer") == version)
    whole = whole_text(docs[text])
    distinct = (  # copies are folded before the exchange, so no group of copies fills a task
        docs.select(F.unhex(F.sha2(whole.cast("binary"), 256)).alias("content"), whole.alias("text"))
        .groupBy("content")
        .agg(F.first("text").alias("text"))
    )
    misses = distinct.join(known, "content", "left_anti")
    fresh = misses.mapInArrow(_counter(tokenizer), "content binary, n_tokens bigint")
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = (
        spark.read.schema(CACHE).parquet(cache)
        .where(F.col("tokenizer") == version)
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    return digests(docs, doc_id, text).join(counts, "content").select("doc_id", "n_bytes", "n_tokens")
