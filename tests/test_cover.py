"""Cover density: golden values, a brute force on random documents, and the ranking rules."""

import itertools
import random

import pytest

from savanto.operators import cover

GOLDEN = {
    "sea thousand years sea thousand years": {3: (4, 4.0), 2: (5, 5.0), 1: (6, 6.0)},
    "sea thousand years": {3: (1, 1.0), 2: (2, 2.0), 1: (3, 3.0)},
    "sea's thousandths years": {1: (1, 1.0)},
    "granite cliff": {},
}


def as_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def levels(spark, texts, query):
    rows = cover.cover_levels(as_docs(spark, texts), cover.make_queries(spark, [query])).collect()
    out = {i: {} for i in range(len(texts))}
    for r in rows:
        out[r.doc_id][r.level] = (r.covers, r.score)
    return out


def test_golden(spark):
    got = levels(spark, list(GOLDEN), "sea thousand years")
    for i, want in enumerate(GOLDEN.values()):
        assert got[i] == want


def brute(tokens, terms, i):
    """All intervals with at least i distinct terms that hold no smaller such interval."""
    n = len(tokens)
    good = {
        (p, q)
        for p, q in itertools.combinations_with_replacement(range(n), 2)
        if len({t for t in tokens[p : q + 1] if t in terms}) >= i
    }
    return [
        (p, q)
        for p, q in good
        if not any((a, b) != (p, q) and a >= p and b <= q for a, b in good)
    ]


def test_random_documents_match_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    for query in ("a b c", "a d", "f"):
        got = levels(spark, texts, query)
        terms = query.split(" ")
        for k, text in enumerate(texts):
            want = {}
            for i in range(1, len(terms) + 1):
                found = brute(text.split(" "), set(terms), i)
                if found:
                    want[i] = (len(found), sum(min(1.0, 3.0 / (q - p + 1)) for p, q in found))
            assert got[k].keys() == want.keys()
            for i in want:
                assert got[k][i][0] == want[i][0]
                assert got[k][i][1] == pytest.approx(want[i][1])


def test_ranking_is_by_level_then_score_then_id(spark):
    texts = ["b a", "a a a a", "a b", "a x x x x b", "c"]
    rows = cover.cover_density(as_docs(spark, texts), cover.make_queries(spark, ["a b"])).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])] == [0, 2, 3, 1]


def test_keeps_twenty(spark):
    rows = cover.cover_density(as_docs(spark, ["a"] * 30), cover.make_queries(spark, ["a"]))
    assert sorted(r.doc_id for r in rows.collect()) == list(range(20))


def test_repeated_terms_empty_terms_and_case(spark):
    assert levels(spark, ["A, b!"], "a  b A")[0] == levels(spark, ["a b"], "a b")[0]
    assert levels(spark, ["", " ", "a"], "") == {0: {}, 1: {}, 2: {}}


def test_space_is_the_only_separator(spark):
    assert levels(spark, ["a\nb"], "ab")[0] == {1: (1, 1.0)}


def test_batch_of_queries_of_different_length(spark):
    docs = as_docs(spark, ["a b c", "b c"])
    rows = cover.cover_scores(docs, cover.make_queries(spark, [("x", "a b c"), ("y", "c")])).collect()
    assert {(r.query_id, r.doc_id, r.level) for r in rows} == {("x", 0, 3), ("x", 1, 2), ("y", 0, 1), ("y", 1, 1)}


def test_long_query_and_a_batch_of_any_size(spark):
    words = [f"w{i}" for i in range(300)]
    got = levels(spark, [" ".join(words), "w7 w9 w7"], " ".join(words))
    assert got[0][300] == (1, pytest.approx(3 / 300)) and got[0][1] == (300, 300.0) and len(got[0]) == 300
    assert got[1] == {1: (3, 3.0), 2: (2, 2.0)}
    many = cover.make_queries(spark, [f"w{i}" for i in range(3000)])
    assert cover.cover_scores(as_docs(spark, ["w1 w2999"]), many).count() == 2
