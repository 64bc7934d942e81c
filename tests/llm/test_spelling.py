"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from savanto.llm import queries, spelling
from tests.llm.data import no_docs, odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_counts(rows, rule):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if rule.drop and h % rule.drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= rule.letters and c >= rule.least}


def all_near(words):
    """Near words by what is left when one place is blanked out, or taken out."""
    blanked, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            blanked.setdefault((w[:i], w[i + 1 :]), []).append(w)
            if (v := w[:i] + w[i + 1 :]) in near:
                near[w].add(v)
                near[v].add(w)
    for group in blanked.values():
        for w in group:
            near[w].update(v for v in group if v != w)
    return near


def brute(n, rule):
    near = all_near(n)
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= rule.times * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), c, len(near[w]), n.get(form.get(w), -1)) for w, c in n.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("rule", [spelling.Spelling(6, 1, 3, 2), spelling.Spelling(5, 2, 7, 2), spelling.Spelling(6, 5, 0, 5)])
def test_odd_documents(spark, rule):
    docs = odd_docs(spark)
    rows = [(r.doc_id, (r.text or "")[:4000]) for r in docs.collect()]
    short = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(brute_counts(rows, rule), rule)
    assert got(spelling.variants(short, rule)) == want and len(want) > 20


@pytest.mark.parametrize("part, searches, leaf", [(4096, 1 << 16, 4), (3, 5, 1)])
def test_near_words_of_a_dense_vocabulary(spark, part, searches, leaf, monkeypatch):
    """Short words over few letters, accents and anagrams: many near pairs, also with tiny tries."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abeoé") for _ in range(rng.randint(1, 6))) for _ in range(500)}
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "SEARCHES", searches)
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n bigint")
    found = [(r.word, r.other, r.other_n) for r in spelling.near_words(df).collect()]
    want = sorted((a, b, len(b)) for a in words for b in words if abs(len(a) - len(b)) <= 1 and distance(a, b) == 1)
    assert sorted(found) == want and len(want) > 1000


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1), (a, b)


def test_anagrams_in_one_node():
    rng = random.Random(3)
    words = sorted({"".join(rng.sample("aaiiaaii", 8)) for _ in range(400)})
    trie = spelling.Trie(words, [1] * len(words))
    asked = words + [w[1:] for w in words] + [w + "i" for w in words]
    pairs = {(asked[i], trie.words[k]) for i, k in trie.near(asked)}
    assert pairs == {(a, b) for a in asked for b in words if abs(len(a) - len(b)) <= 1 and distance(a, b) == 1}


def test_forms_of_forms(spark):
    text = " ".join(["letters"] * 60 + ["lettters"] * 10 + ["letttters"] * 2 + ["otherés"] * 3)
    rows = got(spelling.variants(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spelling.Spelling(6, 1)))
    assert [(w, f, r) for w, f, r, *_ in rows] == [("letters", "", "letters"), ("lettters", "letters", "letters"), ("letttters", "lettters", "letters"), ("otherés", "", "otherés")]


def test_long_texts_and_no_documents(spark):
    assert spelling.variants(no_docs(spark)).count() == 0
    text = "étoile Zebras ".encode().lower() * 100
    parts = list(spelling.stretches(text, 50))
    assert b"".join(parts) == text and sum((Counter(spelling.RUN.findall(p)) for p in parts), Counter()) == Counter(spelling.RUN.findall(text))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    n = brute_counts(rows, queries.SPELLING)
    assert got(queries.spelling_query(spark, folder)) == brute(n, queries.SPELLING) and len(n) > 500
