"""Topic vectors, the index, and their behaviour for very large keys."""

import random
from collections import Counter

from pyspark.sql import functions as F

from savanto.functions import text as tx
from savanto.operators import topics
from savanto.session import written
from savanto.skew import adjacent_pairs, broadcast_if_small, global_rank


def lists_of(spark, texts):
    rows = [(i, name, desc) for i, (name, desc) in enumerate(texts)]
    return spark.createDataFrame(rows, "list_id bigint, name string, description string")


def vectors_of(spark, texts, members, **kw):
    member_of = spark.createDataFrame(members, "user_id bigint, list_id bigint")
    rows = topics.topic_vectors(member_of, lists_of(spark, texts), **kw).collect()
    return {(r.user_id, r.topic): r.freq for r in rows}


def test_vector_counts_and_pairs_across_lists(spark):
    got = vectors_of(spark, [("Web dev", None), ("dev tools", "the"), (None, None)], [(1, 0), (1, 1), (1, 2), (2, 1)])
    assert got == {
        (1, "web"): 2, (1, "dev"): 3, (1, "tool"): 2,
        (1, "web dev"): 1, (1, "dev dev"): 1, (1, "dev tool"): 1,
        (2, "dev"): 2, (2, "tool"): 2, (2, "dev tool"): 1,
    }


def test_domain_words_are_removed_in_any_case(spark):
    got = vectors_of(spark, [("My Twitter LIST of Formulist", "rust")], [(1, 0)])
    assert got == {(1, "rust"): 2}


def test_lookup_tables(spark):
    stems = spark.createDataFrame([("running", "run")], "token string, stem string")
    lexicon = spark.createDataFrame([("run", "NN"), ("fast", "RB")], "token string, tag string")
    assert vectors_of(spark, [("running fast", "")], [(1, 0)], stems=stems, lexicon=lexicon) == {(1, "run"): 2}


def test_adjacent_pairs_with_small_blocks(spark):
    rng = random.Random(3)
    rows = []
    for user in (1, 2):
        for o in sorted(rng.sample(range(1 << 40), 40)) + list(range(30)):
            rows.append((user, o, f"f{o}", f"l{o}"))
    df = spark.createDataFrame(rows, "u bigint, o bigint, f string, l string")
    want = set()
    for user in (1, 2):
        mine = sorted(r for r in rows if r[0] == user)
        want |= {(user, a[3], b[2]) for a, b in zip(mine, mine[1:])}
    for bits in (3, 21):
        got = adjacent_pairs(df, "u", "o", "f", "l", bits=bits).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_index_blocks_stay_bounded(spark):
    vectors = spark.range(1000).select(F.col("id").alias("user_id"), F.lit("big data").alias("topic"), F.lit(2).alias("freq"))
    blocks = topics.index_blocks(vectors, bits=6)
    sizes = [r.users for r in blocks.collect()]
    assert max(sizes) <= 64 and sum(sizes) == 2000
    assert topics.read_blocks(blocks).distinct().count() == 2000


def test_vectors_survive_storage_in_shards(spark):
    vectors = spark.range(500).select(
        (F.col("id") % 2).alias("user_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("topic"), F.col("id").alias("freq")
    )
    encoded = topics.encode_vectors(vectors, entries=50)
    assert encoded.count() > 2
    back = topics.decode_vectors(encoded)
    assert back.exceptAll(vectors).isEmpty() and vectors.exceptAll(back).isEmpty()


def test_camel_case_handles_and_separators(spark):
    row = spark.createDataFrame([("@joe HTMLParser_andMore a-b/c &amp; x@y",)], "t string")
    got = row.select(tx.raw_tokens(F.col("t")).alias("x")).first().x
    assert got == ["HTML", "Parser", "and", "More", "a", "b", "c", "x", "y"]


def test_stemmer(spark):
    words = ["cities", "classes", "cats", "glass", "bus", "gas", "horses"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == {
        "cities": "city", "classes": "classe", "cats": "cat", "glass": "glass", "bus": "bus", "gas": "gas", "horses": "horse",
    }


def test_global_rank_with_one_value_in_all_rows(spark):
    df = spark.range(0, 5000, numPartitions=7).withColumn("s", F.lit(1))
    ranked = global_rank(df, [F.desc("s"), F.col("id")])
    assert ranked.where(F.col("rn") != F.col("id") + 1).count() == 0


def test_candidates_of_an_empty_query(spark):
    vectors = spark.createDataFrame([(1, "a b", 1)], "user_id bigint, topic string, freq bigint")
    queries = spark.createDataFrame([(0, ""), (1, "B's")], "query_id bigint, query string")
    got = topics.candidates(queries, topics.index_rows(vectors), vectors).collect()
    assert [tuple(r) for r in got] == [(1, 1)]


def test_frequencies_equal_a_plain_count(spark):
    rng = random.Random(9)
    words = ["red", "blue", "hot", "ring", "bolt"]
    texts = [(" ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=2))) for _ in range(20)]
    members = [(u, i) for u in range(4) for i in range(20) if rng.random() < 0.5]
    want = {}
    for u in range(4):
        stream = [w for i in sorted(i for v, i in members if v == u) for w in " ".join(texts[i]).split()]
        for w, n in Counter(stream).items():
            want[(u, w)] = n + 1
        for a, b in zip(stream, stream[1:]):
            want[(u, f"{a} {b}")] = 1
    assert vectors_of(spark, texts, members) == want


def test_counts_of_one_block_are_not_exchanged_again(spark):
    """A list's words are made once, and counted where the window has put them."""
    texts = [("web dev", "rust"), ("rust", ""), ("go web", ""), (None, "the"), ("dev", "dev rust")]
    members = [(u, i) for u in range(5) for i in range(5) if (u + i) % 3]
    lists = lists_of(spark, texts)
    member_of = spark.createDataFrame(members, "user_id bigint, list_id bigint")
    plan = topics.topic_vectors(member_of, lists)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and "topic" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    far = topics.topic_vectors(
        member_of.selectExpr("user_id", "list_id << 21 as list_id"), lists.selectExpr("list_id << 21 as list_id", "name", "description")
    )
    one = vectors_of(spark, texts, members)
    assert {(r.user_id, r.topic): r.freq for r in far.collect()} == one  # five blocks
    assert one[0, "web dev"] == 1 and one[0, "rust go"] == 1


def joins_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Join" in line]


def test_list_texts_are_never_broadcast(spark):
    """A small file of lists may hold words that no driver can; Spark sees the file's size only."""
    lists = written(lists_of(spark, [("web dev", "rust"), ("go web", None)]), "lists")
    member_of = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "user_id bigint, list_id bigint")
    vectors = topics.topic_vectors(member_of, lists)
    assert [line for line in joins_of(vectors) if "SortMergeJoin [list_id" in line] and not [line for line in joins_of(vectors) if "Broadcast" in line]
    assert {(r.user_id, r.topic): r.freq for r in vectors.collect()}[1, "rust go"] == 1


def test_candidates_do_not_broadcast_the_vectors(spark):
    rows = [(1, "a b", 1), (1, "b", 2), (2, "c", 2), (None, "b", 2)]
    vectors = written(spark.createDataFrame(rows, "user_id bigint, topic string, freq bigint"), "vectors")
    index = topics.index_rows(vectors).unionByName(spark.createDataFrame([("b", 3)], "word string, user_id bigint"))
    queries = spark.createDataFrame([(0, "B"), (1, "c a")], "query_id bigint, query string")
    got = topics.candidates(queries, index, vectors)
    assert all("SortMergeJoin" in line for line in joins_of(got) if "LeftSemi" in line)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1), (1, 1), (1, 2)]


def test_a_large_side_in_a_small_file_is_not_broadcast(spark):
    large = written(spark.range(50_000).select("id", F.lit("x" * 300).alias("text")), "large")
    joined = spark.range(10).join(broadcast_if_small(large), "id")
    assert "SortMergeJoin" in joins_of(joined)[0] and joined.count() == 10
    assert "BroadcastHashJoin" in joins_of(spark.range(10).join(broadcast_if_small(large.limit(5)), "id"))[0]
