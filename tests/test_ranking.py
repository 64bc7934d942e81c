"""Ranking, fusion and provenance."""

import math
import re

import pytest

from savanto.operators import cover, ranking, topics
from savanto.plans import search as plan
from savanto.session import written


@pytest.fixture(scope="module")
def world(spark):
    frame = spark.createDataFrame
    vectors = frame(
        [(1, "red ring", 1), (1, "red", 3), (2, "ring", 5), (3, "blue", 9), (4, "ring", 2)],
        "user_id bigint, topic string, freq bigint",
    )
    profiles = frame(
        [(1, "u1", 20), (2, "u2", 1), (3, "u3", 50), (5, "u5", 7)],
        "user_id bigint, screen_name string, listed_count bigint",
    ).selectExpr("*", "screen_name as name", "'' as description", "true as verified")
    se = frame(
        [("red ring", "a", 10.0), ("red ring", "b", 20.0), ("string", "c", 99.0), ("ring-fan", "b", 1.0)],
        "topic string, expert string, score double",
    )
    q = frame([("ring theory", "a", 3.0), ("hot ring", "b", 8.0)], "topic string, expert string, score double")
    crosswalk = frame([("a", "u1"), ("b", "u5"), ("c", "u3")], "expert string, screen_name string")
    return plan.Sources(topics.postings(vectors), profiles, se, q, crosswalk)


def scores(df):
    return {r.user_id: (round(r.score, 6), r.flag) for r in df.collect()}


def test_rank_one_network(spark, world):
    got = scores(ranking.rank_users(cover.make_queries(spark, ["red ring"]), world.postings, world.profiles))
    assert got == {
        1: (round(4 * math.log(20), 6), 0),
        2: (0.0, 0),  # ln 1
        4: (round(2 * math.log(10), 6), 0),  # no profile: weight of 10
    }


def test_postings_are_exchanged_by_user(spark, world, monkeypatch):
    """A topic of all users is no large group, and the parts follow the rows that the queries make."""
    vectors = spark.range(200).selectExpr("id as user_id", "'red ring' as topic", "2L as freq")
    queries = cover.make_queries(spark, ["red", "ring", "red ring"])
    monkeypatch.setattr(ranking, "SUMMED_ROWS", 10)
    ranked = ranking.rank_users(queries, topics.postings(vectors), world.profiles)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and not re.search(r"hashpartitioning\((word#\d+, topic|topic#\d+, word)", plan)
    assert "60), REPARTITION_BY_NUM" in plan  # 600 rows
    assert ranked.count() == 600 and ranked.where("user_id = 4").first().score == pytest.approx(2 * math.log(10))


@pytest.mark.parametrize("listed", [1000, 1])
def test_words_of_the_queries_are_in_the_scan(spark, world, monkeypatch, listed):
    """Stored postings of other words are left undecoded; a batch of more words than are listed is joined only."""
    monkeypatch.setattr(ranking, "LISTED_WORDS", listed)
    stored = written(world.postings, "postings")
    ranked = ranking.rank_users(cover.make_queries(spark, ["red ring"]), stored, world.profiles)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert ("In(word, [red,ring])" in plan or "In(word, [ring,red])" in plan) == (listed > 1)
    assert {u: round(s, 6) for u, (s, _) in scores(ranked).items()} == {1: round(4 * math.log(20), 6), 2: 0.0, 4: round(2 * math.log(10), 6)}


def test_all_topics_of_a_user_count(spark):
    rows = [(u, f"w{i:03d} red", 1 + (i * u) % 7) for u in (1, 2) for i in range(60 if u == 1 else 25)]
    vectors = spark.createDataFrame(rows, "user_id bigint, topic string, freq bigint")
    profiles = spark.createDataFrame([(1, 3), (2, 3)], "user_id bigint, listed_count bigint")
    queries = cover.make_queries(spark, ["red"])
    got = scores(ranking.rank_users(queries, topics.postings(vectors), profiles))
    assert {u: s for u, (s, _) in got.items()} == {
        v: round(sum(f for u, _, f in rows if u == v) * math.log(3), 6) for v in (1, 2)
    }


def test_all_matching_topics_are_fused_and_a_limit_is_optional(spark):
    labels = spark.createDataFrame([(f"ring {i:02d}",) for i in range(45)], "topic string")
    queries = cover.make_queries(spark, ["ring"])
    assert ranking.topic_match(queries, labels, "prefix").count() == 45
    assert ranking.topic_match(queries, labels, "prefix", limit=20).count() == 20


def test_fusion(spark, world):
    queries = cover.make_queries(spark, ["ring"])
    base = ranking.rank_users(queries, world.postings, world.profiles)
    low, high = 0.0, max(s for s, _ in scores(base).values())
    got = scores(plan.rank(queries, world, include_se=True))
    # rescaled: a 10, b max(20, 1); span 1..20. "string" has no term "ring", so c is not found
    a = (10 - 1) / 19 * (high - low) + low
    assert got[1] == (round(0.5 * math.log(20) + 0.5 * a, 6), ranking.SE_MERGED)
    assert got[5] == (round(high, 6), ranking.SE_ADDED)
    assert 3 not in got
    both = scores(plan.rank(queries, world, include_se=True, include_q=True))
    # only topics that start with the query count here: one expert, so the range is a point
    assert both[1] == (round(0.5 * (0.5 * math.log(20) + 0.5 * a) + 0.5 * high, 6), ranking.Q_MERGED)
    assert both[5] == got[5]


def test_nothing_is_added_to_an_empty_base(spark, world):
    queries = cover.make_queries(spark, ["theory"])
    assert plan.rank(queries, world, True, True).count() == 0


def test_wildcards_of_the_query_are_not_live(spark, world):
    queries = cover.make_queries(spark, ["r%ng"])
    topics = world.se_topic_experts.select("topic").distinct()
    assert ranking.topic_match(queries, topics, "contains").count() == 0


def test_profiles_stats_and_flags(spark):
    rows = spark.createDataFrame([(0, 1, 4.0, 0), (0, 2, 2.0, 0)], "query_id int, user_id int, score double, flag int")
    other = spark.createDataFrame([(0, 2, 4.0), (0, 3, 3.0)], "query_id int, user_id int, external double")
    assert scores(ranking.fuse(rows, other, 1, 2, "from_se")) == {1: (4.0, 0), 2: (3.0, 1), 3: (3.0, 2)}
    second = ranking.fuse(ranking.fuse(rows, other, 1, 2, "from_se"), other, 3, 4, "from_q")
    assert {r.user_id: (r.flag, r.from_se, r.from_q) for r in second.collect()} == {
        1: (0, False, False), 2: (3, True, True), 3: (3, True, True),
    }
    stats = ranking.merge_stats(second).first()
    assert (stats.results, stats.so_merged, stats.q_merged, stats.q_added) == (3, 0, 2, 0)


def test_rows_without_a_profile_drop_out(spark, world):
    out = plan.search(cover.make_queries(spark, ["ring"]), world, False, False)
    assert [r.user_id for r in out.collect()] == [1, 2]
