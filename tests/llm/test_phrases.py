"""The index over word ids and the collocations, against plain counting."""

import collections
import re

import numpy as np
import pytest

from savanto.llm import phrases
from savanto.llm.word_index import WordIndex
from tests.llm.data import no_docs, odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))]


def counts(texts, longest):
    n = collections.Counter()
    for text in texts:
        for words in pieces(text):
            for size in range(1, longest + 1):
                n.update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return n


def brute(rows, rule, first):
    """``rows`` of (lang, text)."""
    out = []
    by_lang = collections.defaultdict(list)
    for lang, text in rows:
        by_lang[lang or "und"].append(text)
    for lang, texts in by_lang.items():
        f = counts(texts, rule.longest)
        total = sum(v for k, v in f.items() if " " not in k)
        cand = {p: a for p, a in f.items() if " " in p and a >= rule.least}
        kept = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = [(1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            longer = [b for q, b in cand.items() if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
            if not any(100 * b >= rule.covered * a for b in longer):
                kept.append((score, a, p, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, r, total, score) for i, (score, a, p, left, r) in enumerate(kept[:first])]
    return sorted(out)


@pytest.mark.parametrize("longest", [1, 2, 3, 4, 5])
def test_index_lists_every_phrase_once(longest):
    rng = np.random.default_rng(longest)
    raw = " ".join(rng.choice(["a", "b", "c", "A", "dd", ".", "e,", "\t", "!"], 3000)).encode()
    words, text = phrases.word_ids(raw)
    names = [b"", *words]
    index = WordIndex.build(text, len(names), longest)
    got = collections.Counter()
    for p in index.phrases(longest):
        assert (p.n > 0).all()
        for ids, n in zip(p.words.tolist(), p.n.tolist(), strict=True):
            assert b" ".join(names[i] for i in ids) not in got
            got[b" ".join(names[i] for i in ids)] = n
        # both intervals of a phrase: rotations of either text that start with it
    assert got == {k.encode(): v for k, v in counts([raw.decode()], longest).items()}


def test_index_of_one_word():
    words, text = phrases.word_ids(b"x")
    assert words == [b"x"] and [p.n.tolist() for p in WordIndex.build(text, 2, 3).phrases(3)] == [[1], [], []]


@pytest.mark.parametrize("rule", [phrases.Rule(3, 10, 50), phrases.Rule(3, 2, 100), phrases.Rule(4, 3, 80)])
@pytest.mark.parametrize("sizes", [phrases.Sizes(), phrases.Sizes(shard=3000, range=5000), phrases.Sizes(bits=6)])
def test_collocations_of_odd_documents(spark, rule, sizes):
    """Whole, in small shards and ranges, and with hashes that clash."""
    docs = odd_docs(spark)
    got = phrases.collocations(docs, 50, rule, sizes).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()], rule, 50)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 2


def test_no_documents(spark):
    assert phrases.collocations(no_docs(spark)).count() == 0


def test_long_texts_are_parted_at_piece_ends():
    text = b"ab cd. " * 50 + b"x" * 500 + b"; y z"
    parts = list(phrases.stretches(text, 60))
    assert b"".join(parts) == text and len(parts) > 5
    total = collections.Counter()
    for p in parts:
        total += counts([p.decode()], 3)
    assert total == counts([text.decode()], 3)


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 1000, 65536, 70001])
def test_keys_of_ranges(n):
    ranges, rng = phrases.Ranges(n), np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 48, 5000, np.uint64), np.array([0, (1 << 48) - 1], np.uint64)]))
    starts = np.array([ranges.start(int(r)) for r in ranges.of(keys)], np.uint64)
    assert (keys >= starts).all() and (ranges.of(starts) == ranges.of(keys)).all()
    assert (ranges.unpack(ranges.pack(keys - starts)) + starts == keys).all()
    assert ranges.width == (6 if n < 256 else 5 if n < 65536 else 4)


def test_tasks_get_one_shard_at_a_time(spark, monkeypatch):
    batch, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before = spark.conf.get(batch)
    store = phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, label: seen.update({label: spark.conf.get(batch)}) or store(df, label))
    docs = spark.createDataFrame([("en", "a b c. " * 40)] * 8, "lang string, text string")
    counted, _ = phrases.frequent(docs, sizes=phrases.Sizes(shard=64, range=4))
    assert {r.phrase: r.n for r in counted.collect()} == {p: 320 for p in ("a", "b", "c", "a b", "b c", "a b c")}
    assert seen == {"word-indexes": before, "phrases": "1"} and spark.conf.get(batch) == before
