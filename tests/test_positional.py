"""Searches over stored postings: the same rows as scoring every document, from part of the blocks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from savanto.operators import cover, positional
from savanto.session import new_path

QUERIES = ["a b c", "d", "a zz", "e f", "nothing", "zz a b"]


def texts(n, seed):
    rng = random.Random(seed)
    rows = [" ".join(rng.choice("aaabbcde,.fgh") for _ in range(int(2 ** rng.uniform(0, 8)))) for _ in range(n)]
    return [*rows, "zz a", None, "", "a" * 3000, rows[0], rows[0]]


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.level, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("block_docs, limit", [(1024, 20), (4, 3), (1, 1)])
def test_same_as_a_scan(spark, block_docs, limit):
    docs = spark.createDataFrame(list(enumerate(texts(300, block_docs))), "doc_id bigint, text string")
    index = positional.build(docs, new_path(spark, "positional"), folders=5, block_docs=block_docs)
    queries = cover.make_queries(spark, QUERIES)
    assert rows_of(positional.search(index, queries, limit)) == rows_of(cover.cover_density(docs, queries, limit=limit))


def test_blocks_without_hope_are_not_read(spark):
    rng = random.Random(1)
    rows = [("a b " * 30 if i % 97 == 0 else " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 8, 16, 60])))) for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    index = positional.build(docs, new_path(spark, "positional"), folders=4, block_docs=16)
    queries = cover.make_queries(spark, ["a b"])
    best, read = positional._searched(index, queries, 20)
    assert rows_of(best) == rows_of(cover.cover_density(docs, queries))
    blocks = index.summaries(spark).where(F.col("term").isin("a", "b")).select("block").distinct().count()
    assert read.distinct().count() == read.count() <= blocks / 2


def test_only_the_terms_are_scanned(spark):
    docs = spark.createDataFrame(list(enumerate(texts(200, 9))), "doc_id bigint, text string")
    index = positional.build(docs, new_path(spark, "positional"), folders=16)
    terms = cover.query_terms(cover.make_queries(spark, ["a zz"]))
    found = positional.of_terms(index.postings(spark), terms, index.folders)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [a,zz])" in plan.replace("\n", "")
    scan = next(line for line in plan.split("\n") if "PartitionFilters: [folder" in line)
    assert "folder#" in scan
    opened = {f.split("folder=")[1].split("/")[0] for f in index.postings(spark).where(F.col("term").isin("a", "zz")).inputFiles()}
    assert len(opened) > 2  # all folders, where only the terms select
    wanted = {r.f for r in terms.select(positional.folder_of(F.col("term"), 16).alias("f")).collect()}
    assert {r.folder for r in found.collect()} <= wanted


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    index = positional.build(docs, new_path(spark, "positional"))
    assert positional.search(index, cover.make_queries(spark, ["a b"])).count() == 0


def test_documents_of_a_block_share_a_row(monkeypatch):
    """A document's tokens are put together in the task that has its text, whatever the slices."""
    texts = ["b a b", "", " a", "c", "b  b é"]
    batch = pa.RecordBatch.from_arrays([pa.array([4, 5, None, 7, 8]), pa.array(["x", "x", "x", "y", "x"]), pa.array(texts)], ["id", "block", "text"])
    (rows,) = positional._postings(iter([batch]))
    got = {(r["term"], r["block"]): list(zip(r["keys"], r["positions"])) for r in rows.to_pylist()}
    assert len(got) == rows.num_rows
    assert got == {("b", "x"): [(4, [0, 2]), (8, [0, 2])], ("a", "x"): [(4, [1]), (None, [1])], ("é", "x"): [(8, [3])], ("c", "y"): [(7, [0])]}
    monkeypatch.setattr(positional, "SLICE_BYTES", 1)
    parts = [r for part in positional._postings(iter([batch])) for r in part.to_pylist()]
    again = {}
    for r in parts:
        again.setdefault((r["term"], r["block"]), []).extend(zip(r["keys"], r["positions"]))
    assert again == got and len(parts) == 6


def test_rows_that_share_a_key_are_one_document(spark):
    rows = [(i % 150, text) for i, text in enumerate(texts(300, 3))] + [(None, "a zz b"), (None, "c a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = positional.build(docs, new_path(spark, "positional"), folders=5, block_docs=4)
    queries = cover.make_queries(spark, ["a b c", "e f", "zz a b"])
    scored = positional.search(index, queries, 400).collect()
    want = cover.cover_density(docs, queries, limit=400).collect()
    assert {(r.query_id, r.doc_id, r.level, round(r.score, 9)) for r in scored} == {(r.query_id, r.doc_id, r.level, round(r.score, 9)) for r in want}
