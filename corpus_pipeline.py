"""From raw documents to training ids: toxicity, exact and near duplicates, mixing, encoding.

Every stage takes the documents that the one before kept and returns the columns of documents; the last
one returns their ids as digests. Stages are stored between each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from savanto.llm import bpe, exact_dedup, minhash, mixing, toxicity
from savanto.llm.common import table
from savanto.session import written

#: Near duplicates share eight in ten shingles of five words.
NEAR = minhash.Likeness(words=5, percent=80)
#: Every document is used at least once, and those of no source more than one and a half times on average.
MIXTURE = mixing.Target(repeats=1.5)
TOKENIZER = "byte_bpe_50k.json"
#: Bytes that Spark hands to a Python worker at once. Both sides hold a batch as a whole, and rows are long.
BATCH_BYTES = 2 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below the threshold; learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts, the one with the largest id."""
    return exact_dedup.deduplicated(docs, exact_dedup.earlier_half(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return minhash.deduplicated(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's weight asks for."""
    return mixing.mix(docs, MIXTURE).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text decoded from them, as digests."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    path = public_tokenizers.path(TOKENIZER)
    return bpe.digests(bpe.encode(docs, path, keep=["doc_id"], decoded="decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Signatures, boosted trees and the encoding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
