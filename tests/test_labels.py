"""Labels found by a part or their beginning: the same as testing all of them."""

import random

import pytest
from pyspark.sql import functions as F

from savanto.operators import cover, ranking
from savanto.operators.labels import LabelIndex
from savanto.session import new_path


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(8)
    words = ["red", "Ring", "data-base", "ab", "a", "İx", "été", "zz%", "o'neil"]
    topics = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(300)} | {"", "  ", "x"})
    df = spark.createDataFrame([(t,) for t in [*topics, topics[0], None]], "topic string")
    return topics, df, LabelIndex.build(df, new_path(spark, "labels"))


QUERIES = ["ring", "a", "ab", "red ring", "zz%", "%", "data base", "o'n", "nosuch", "aaaa", " RING ", "été", "", "x"]


@pytest.mark.parametrize("how", ["contains", "prefix"])
def test_lookup(spark, labels, how):
    topics, df, index = labels
    queries = cover.make_queries(spark, QUERIES)
    label = {r.topic: r.label for r in df.where("topic is not null").distinct().select("topic", F.replace(F.lower("topic"), F.lit("-"), F.lit(" ")).alias("label")).collect()}
    got = [(r.query_id, r.topic) for r in index.lookup(queries, how).collect()]
    test = (lambda text, q: q in text) if how == "contains" else str.startswith
    want = [(i, t) for i, q in enumerate(QUERIES) if (raw := q.strip(" ").lower()) for t in topics if test(label[t], raw)]
    assert sorted(got) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("how", ["contains", "prefix"])
def test_topic_match_is_the_same_with_an_index(spark, labels, how):
    _, df, index = labels
    queries = cover.make_queries(spark, [q for q in QUERIES if q.strip()])
    rows = lambda topics: sorted(map(tuple, ranking.topic_match(queries, topics, how).collect()))
    assert rows(index) == rows(df.where("topic is not null").distinct()) != []


def test_only_the_asked_grams_are_scanned(spark, labels):
    plan = labels[2].lookup(cover.make_queries(spark, ["ring"]))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram," in plan or "In(gram, [" in plan


def test_no_labels(spark):
    index = LabelIndex.build(spark.createDataFrame([], "topic string"), new_path(spark, "labels"))
    assert index.lookup(cover.make_queries(spark, ["a"])).count() == 0


def test_a_label_meets_a_query_by_its_whole_beginning(spark, tmp_path):
    """Labels that start alike are not paired with every query that does, and no label is posted under parts of grams."""
    n = 200
    topics = spark.range(n).select(F.format_string("Name#%09d", "id").alias("topic"))
    index = LabelIndex.build(topics, str(tmp_path / "labels"))
    queries = topics.select(F.lower(F.substring("topic", 1, 13)).alias("query")).distinct().withColumn("query_id", F.col("query"))
    found = index.lookup(queries, "prefix")
    assert found.count() == n
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join [" in line]
    assert len(joins) == 2 and sum("[gram" in line and "query" in line for line in joins) == 1
    assert index.postings(spark).groupBy("topic").count().agg(F.max("count")).first()[0] <= 14


def test_short_queries_find_a_label_once(spark, tmp_path):
    index = LabelIndex.build(spark.createDataFrame([("abab",), ("ba",), ("b",), ("aab-",), ("",)], "topic string"), str(tmp_path / "labels"))
    queries = cover.make_queries(spark, ["a", "ab", "b", "aba", "ba"])
    got = {how: sorted((r.query_id, r.topic) for r in index.lookup(queries, how).collect()) for how in ("contains", "prefix")}
    assert got["contains"] == [(0, "aab-"), (0, "abab"), (0, "ba"), (1, "aab-"), (1, "abab"), (2, "aab-"), (2, "abab"), (2, "b"), (2, "ba"), (3, "abab"), (4, "abab"), (4, "ba")]
    assert got["prefix"] == [(0, "aab-"), (0, "abab"), (1, "abab"), (2, "b"), (2, "ba"), (3, "abab"), (4, "ba")]
