"""Cover-density ranking.

A minimal i-cover of a document is a shortest token interval holding at least i distinct query
terms, with no smaller such interval inside. For a hit at position p, sort the next position of
every query term: the i-th one, q_i(p), ends the interval that starts at p. It is minimal exactly
when the following hit reaches a later end. So one walk back over a document's hits is enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from savanto.functions import text as tx
from savanto.skew import broadcast_if_small

KAPPA = 3.0  # fixed value: covers up to this length score 1
DIGITS = 9  # decimals by which two scores are told apart
KEPT_DOCUMENTS = 20  # fixed value: documents a search shows per query


def make_queries(spark: SparkSession, queries: DataFrame | Iterable[str] | Iterable[tuple]) -> DataFrame:
    """``(query_id, query)``; plain strings are numbered from 0."""
    if isinstance(queries, DataFrame):
        return queries.select("query_id", "query")
    rows = [(i, q) if isinstance(q, str) else tuple(q) for i, q in enumerate(queries)]
    kind = "string" if rows and isinstance(rows[0][0], str) else "bigint"
    return spark.createDataFrame(rows, f"query_id {kind}, query string")


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, slot, term)``: distinct lower-cased terms; empty terms are dropped."""
    words = F.array_distinct(F.filter(F.split(F.lower("query"), " "), lambda t: t != ""))
    return queries.select("query_id", F.posexplode(words).alias("slot", "term"))


def hits(docs: DataFrame, terms: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """``(query_id, *key, pos, slot, term)``: positions of query terms; other tokens end here, unshuffled
    where the terms are few."""
    tokens = docs.select(*key, F.posexplode(tx.blank_separated(F.col(text))).alias("pos", "term"))
    return tokens.join(broadcast_if_small(terms), "term").select("query_id", *key, "pos", "slot", "term")


def _walk(found: Column) -> Column:
    """Covers and scores level by level, from a document's hits ``(pos, slot)`` in order.

    The state holds the next position of each term seen so far, nearest first, and the sums. A hit moves
    its term to the front; the i-th position ends a minimal cover where the state before had a later one.
    """
    ends = F.array().cast("array<struct<slot:int,pos:int>>")
    sums = F.array().cast("array<struct<covers:bigint,score:double>>")

    def step(state: Column, hit: Column) -> Column:
        others = F.filter(state["ends"], lambda e: e["slot"] != hit["slot"])
        now = F.concat(F.array(F.struct(hit["slot"].alias("slot"), hit["pos"].alias("pos"))), others)

        def add(end: Column, i: Column) -> Column:
            later, before = F.get(state["ends"], i)["pos"], F.get(state["sums"], i)
            minimal = later.isNull() | (later > end["pos"])
            score = F.least(F.lit(1.0), F.lit(KAPPA) / (end["pos"] - hit["pos"] + 1))
            return F.struct(
                (F.coalesce(before["covers"], F.lit(0)) + minimal.cast("bigint")).alias("covers"),
                (F.coalesce(before["score"], F.lit(0.0)) + F.when(minimal, score).otherwise(0.0)).alias("score"),
            )

        return F.struct(now.alias("ends"), F.transform(now, add).alias("sums"))

    start = F.struct(ends.alias("ends"), sums.alias("sums"))
    return F.aggregate(F.reverse(found), start, step, lambda state: state["sums"])


def _per_level(found: DataFrame, key: Sequence[str], *also: Column) -> DataFrame:
    """``(query_id, *key, *also, levels)`` with ``levels`` an array of (level, covers, score) structs.

    A group holds the hits of one document, so its size is bounded by that of a row of the input.
    """
    hit = F.struct(F.col("pos").cast("int").alias("pos"), F.col("slot").cast("int").alias("slot"))
    return _levels_of(found.groupBy("query_id", *key).agg(F.array_sort(F.collect_list(hit)).alias("hits"), *also))


def _levels_of(grouped: DataFrame) -> DataFrame:
    """The levels of rows with the sorted ``hits (pos, slot)`` of a document."""
    numbered = F.transform(
        _walk(F.col("hits")),
        lambda s, i: F.struct((i + 1).alias("level"), s["covers"].alias("covers"), s["score"].alias("score")),
    )
    others = [c for c in grouped.columns if c != "hits"]
    return grouped.select(*others, F.filter(numbered, lambda x: x["covers"] > 0).alias("levels"))


def cover_levels(
    docs: DataFrame, queries: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``(query_id, *key, level, covers, score)``: every level a document satisfies."""
    per_doc = _per_level(hits(docs, query_terms(queries), key, text), key)
    return per_doc.select("query_id", *key, F.inline("levels"))


def cover_scores(
    docs: DataFrame, queries: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``(query_id, *key, level, score)``: each matching document at its highest level only."""
    return _top_level(_per_level(hits(docs, query_terms(queries), key, text), key), key)


def term_scores(topics: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, topic, level, score, word)`` for short texts that repeat much: each is scored once.

    ``topics`` needs its ``topic`` column only; ``word`` is one of the query terms the topic holds.
    """
    texts = topics.select("topic").distinct().withColumn("__text", F.col("topic"))
    per_topic = _per_level(hits(texts, terms, ["topic"], "__text"), ["topic"], F.min("term").alias("word"))
    return _top_level(per_topic, ["topic", "word"])


def _top_level(per_doc: DataFrame, key: Sequence[str]) -> DataFrame:
    best = F.element_at("levels", -1)
    return per_doc.where(F.size("levels") > 0).select(
        "query_id", *key, best["level"].alias("level"), best["score"].alias("score")
    )


def top_level_of(grouped: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(query_id, *key, level, score)`` of rows with the sorted ``hits (pos, slot)`` of a document."""
    return _top_level(_levels_of(grouped), key)


def keep_ranked(scored: DataFrame, group: Sequence[str], tie: str, limit: int | None = None) -> DataFrame:
    """Rank by level, then score, then ``tie``; keep the first ``limit`` of each group, or all.

    Scores are compared to ``DIGITS`` decimals: the last bits of a sum depend on the order of its parts.

    With a limit Spark drops all but the first rows of a group before the shuffle already.
    """
    order = Window.partitionBy(*group).orderBy(F.desc("level"), F.desc(F.round("score", DIGITS)), tie)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def cover_density(
    docs: DataFrame,
    queries: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int | None = KEPT_DOCUMENTS,
) -> DataFrame:
    """``(query_id, doc, level, score, rank)``: the first ``limit`` documents of every query."""
    return keep_ranked(cover_scores(docs, queries, [key], text), ["query_id"], key, limit)
