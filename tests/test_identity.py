"""Names, signatures and the one-match gate."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from savanto.functions.similarity import jaro_winkler, may_reach
from savanto.functions.values import signature_distance
from savanto.operators import identity


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("MARTHA", "MARHTA", 0.961111),
        ("DIXON", "DICKSONX", 0.813333),
        ("jonskeet", "Jon Skeet", 0.805556),
        ("same", "same", 1.0),
        ("", "x", 0.0),
        (None, "x", None),
    ],
)
def test_jaro_winkler(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(jaro_winkler("a", "b").alias("s")).first().s
    assert got == (None if want is None else pytest.approx(want, abs=1e-6))


def test_signature_distance(spark):
    rows = [(0, [3.0, 4.0], [3.0, 4.0]), (1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0], None), (3, [0.0], [0.0])]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>")
    got = {r.i: r.d for r in df.select("i", signature_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {0: 0.0, 1: pytest.approx(2**0.5 / 2), 2: 1.0, 3: 1.0}


def accounts(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, name string, location string, signature array<float>")
    return df.withColumn("blocks", identity.name_blocks(F.col("name")))


SIG, FAR = [1.0, 0.0], [-1.0, 0.0]


def test_gate_wants_exactly_one_match(spark):
    src = accounts(spark, [(1, "Ann Lee", "Oslo", SIG), (2, "Bob Ray", None, SIG), (3, "Cy Dee", "Rome", SIG)])
    dst = accounts(
        spark,
        [
            (10, "ann lee", "Oslo", SIG),
            (20, "bob ray", "Bern", SIG),
            (21, "bob  ray", "Bern", SIG),
            (30, "Cy Dee", "Rome", FAR),
        ],
    )
    rows = identity.fuzzy_match(src.withColumn("name", F.lower("name")), dst).collect()
    assert [(r.src_id, r.match_id) for r in rows] == [(1, 10)]
    assert rows[0].location_sim == 1.0


def test_names_that_many_accounts_share(spark):
    src = accounts(spark, [(1, "ann", None, SIG), (2, "John Smith", None, SIG)])
    crowd = [(i, "ann", None, SIG if i == 19 else FAR) for i in range(3, 20)]
    johns = [(100 + i, f"John B{i}", None, SIG) for i in range(12)] + [(200 + i, f"B{i} Smith", None, SIG) for i in range(12)]
    dst = accounts(spark, [*crowd, *johns, (300, "John W Smith", None, SIG)])
    assert {(r.src_id, r.match_id) for r in identity.fuzzy_match(src, dst).collect()} >= {(1, 19)}
    names = {(r.src_id, r.match_id) for r in identity.candidate_pairs(src, dst).collect()}
    assert (2, 300) in names and {m for s, m in names if s == 1} == set(range(3, 20))


@pytest.mark.parametrize("common", [identity.COMMON, 2])
def test_every_shared_word_makes_a_candidate(spark, monkeypatch, common):
    monkeypatch.setattr(identity, "COMMON", common)
    words = ["john", "smith", "ann", "lee", "Li-Ng", ""]
    rng = random.Random(5)
    named = lambda first, n: [(first + i, " ".join(rng.choices(words, k=rng.randint(1, 3))), None, SIG) for i in range(n)]
    src, dst = accounts(spark, [(1, "John Smith", None, SIG), (2, "Ann Lee", None, SIG), *named(10, 12)]), accounts(
        spark, [(100, "John Smith", None, SIG), (101, "John W Smith", None, SIG), (102, "ANN LEE", None, SIG), (103, "Zed Lee", None, SIG), *named(200, 30)]
    )
    got = [(r.src_id, r.match_id) for r in identity.candidate_pairs(src, dst).collect()]
    blocks = lambda df: {r.id: set(r.blocks) for r in df.collect()}
    want = {(a, b) for a, x in blocks(src).items() for b, y in blocks(dst).items() if x & y}
    assert len(got) == len(want) and set(got) == want and (1, 101) in want and (2, 103) in want


def test_a_longer_namesake_closes_the_gate(spark):
    src = accounts(spark, [(1, "John Smith", None, SIG), (2, "Ann Lee", None, SIG)])
    dst = accounts(spark, [(10, "John Smith", None, SIG), (11, "John W Smith", None, SIG), (20, "Ann Lee", None, SIG), (21, "Bo Lee", None, SIG)])
    assert [(r.src_id, r.match_id) for r in identity.fuzzy_match(src, dst).collect()] == [(2, 20)]


def test_unlinked_sources_keep_their_row_and_linked_ones_take_fields_over(spark):
    src = accounts(spark, [(1, "ann", None, SIG), (2, "zoe", None, SIG)]).withColumn("so_name", F.lit("old"))
    dst = accounts(spark, [(9, "ann", "Oslo", SIG)])
    got = identity.link_accounts(identity.TWITTER_TO_SE, src, dst, F.lit("now")).collect()
    assert {(r.id, r.so_id, r.so_name, r.so_location) for r in got} == {(1, 9, "ann", "Oslo"), (2, None, "old", None)}
    assert all(r.last_crawled == "now" and r.direction == "twitter_to_stackexchange" for r in got)


def test_to_twitter_the_screen_name_is_compared(spark):
    src = accounts(spark, [(1, "ann lee", None, SIG)])
    dst = accounts(spark, [(8, "ann lee", None, SIG), (9, "ann lee", None, SIG)]).withColumn(
        "screen_name", F.when(F.col("id") == 8, "annlee").otherwise("xyz")
    )
    got = identity.link_accounts(identity.SE_TO_TWITTER, src, dst, F.lit("now")).collect()
    assert [(r.twitter_id, r.twitter_screen_name, r.twitter_name) for r in got] == [(8, "annlee", "ann lee")]


def test_letter_bound_never_loses_a_pair(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("abcd e") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abcd e") for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(jaro_winkler("a", "b").alias("s"), may_reach("a", "b", 0.8).alias("may"), "a", "b").collect()
    assert all(r.may for r in got if r.s > 0.8)
    con = duckdb.connect()
    for r in got:
        if r.a and r.b:
            assert r.s == pytest.approx(con.execute("select jaro_winkler_similarity(?, ?)", [r.a, r.b]).fetchone()[0])
