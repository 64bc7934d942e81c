"""Stored labels found by a part of them or by their beginning, without reading the others.

A label is posted under the gram of three letters at each of its places, which is shorter at its end, with a mark for
the gram it starts with. A query looks up one gram only: for *contains* the rarest it has, by stored counts; for
*starts with* the first one. A query of fewer letters looks up the grams that start with it. What is found there takes
the exact test; labels that start alike meet a query by as many letters as it has. Postings are sorted by gram, so the
scan skips the rest where the grams of a batch can be written into the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savanto.functions import text as tx
from savanto.session import written
from savanto.skew import broadcast_if_small

#: Letters of a gram, and grams that are written into the plan.
LETTERS, LISTED = 3, 1000
#: Labels that one task posts, about.
POSTED = 1 << 15


def grams(text: Column) -> Column:
    """The distinct grams of a text, one for each place."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(LETTERS))))


def _gram_at(text: Column, place: Column) -> Column:
    return F.substr(text, place, F.lit(LETTERS))


@dataclass(frozen=True)
class LabelIndex:
    """Where the postings ``(gram, start, topic)`` and the gram counts are."""

    path: str

    @staticmethod
    def build(topics: DataFrame, path: str) -> LabelIndex:
        """Post the distinct ``topic`` values under the grams of their normal labels."""
        distinct = written(topics.select("topic").where("topic is not null").distinct(), "label-topics")
        # names are small and their postings are not: the tasks follow the number of names, not their bytes
        parts = max(topics.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // POSTED))
        labelled = distinct.repartition(parts, "topic").withColumn("label", tx.normal_label(F.col("topic")))
        label = F.col("label")
        posted = labelled.where(label != "").select("topic", _gram_at(label, F.lit(1)).alias("first"), F.explode(grams(label)).alias("gram"))
        rows = posted.select("gram", (F.col("gram") == F.col("first")).alias("start"), "topic")
        # a common gram's postings are spread over tasks and files by label
        rows.repartitionByRange("gram", "topic").sortWithinPartitions("gram", "start", "topic").write.parquet(f"{path}/postings")
        stored = LabelIndex(path)
        stored.postings(topics.sparkSession).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
        return stored

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("gram string, start boolean, topic string").parquet(f"{self.path}/postings")

    def _asked(self, queries: DataFrame, how: str) -> DataFrame:
        """``(query_id, query, gram)``: the gram each query is looked up by, or those that start with a shorter one; an
        empty query asks for none."""
        text = F.lower(F.trim("query"))
        asked = queries.select("query_id", text.alias("query")).where(F.col("query") != "")
        counts = queries.sparkSession.read.schema("gram string, n bigint").parquet(f"{self.path}/counts")
        short = F.length("query") < LETTERS
        parts = F.array_distinct(F.array(*[F.substr("gram", F.lit(1), F.lit(k)) for k in range(1, LETTERS)]))
        few = asked.where(short).join(counts.select("gram", F.explode(parts).alias("query")), "query").select("query_id", "query", "gram")
        long = asked.where(~short)
        if how != "contains":
            return long.withColumn("gram", _gram_at(F.col("query"), F.lit(1))).unionByName(few)
        whole = F.filter(grams(F.col("query")), lambda g: F.length(g) == LETTERS)
        spread = long.select("query_id", "query", F.explode(whole).alias("gram")).join(counts, "gram", "left")
        # a gram that no label has ends the search: it counts as the rarest
        rarest = spread.groupBy("query_id", "query").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
        return rarest.unionByName(few)

    def lookup(self, queries: DataFrame, how: str = "contains") -> DataFrame:
        """``(query_id, topic, label)``: the labels that contain each query's text, or start with it (``prefix``)."""
        asked = written(self._asked(queries, how), "label-grams")
        listed = [r["gram"] for r in asked.select("gram").distinct().limit(LISTED + 1).collect()]
        found = self.postings(queries.sparkSession)
        if len(listed) <= LISTED:
            found = found.where(F.col("gram").isin(listed))
        label, query = F.col("label"), F.col("query")
        if how != "contains":
            # one row for a gram, with the lengths of its queries: a label is held against its own beginnings only
            lengths = asked.groupBy("gram").agg(F.collect_set(F.length("query")).alias("lengths"))
            began = found.where("start").join(broadcast_if_small(lengths), "gram").withColumn("label", tx.normal_label(F.col("topic")))
            began = began.withColumn("size", F.explode("lengths")).where(F.col("size") <= F.length("label"))
            met = began.withColumn("query", F.substr(label, F.lit(1), F.col("size"))).join(broadcast_if_small(asked), ["gram", "query"])
            return met.select("query_id", "topic", "label")
        met = found.join(broadcast_if_small(asked), "gram").withColumn("label", tx.normal_label(F.col("topic")))
        # a label is taken where the query is first in it, if it meets several grams of a short query
        first = (F.length("query") >= LETTERS) | (_gram_at(label, F.position(query, label)) == F.col("gram"))
        return met.where(F.contains(label, query) & first).select("query_id", "topic", "label")
