"""Deduplication, near duplicates, line runs, fingerprints, shards, mixtures and toxicity on odd documents."""

import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from savanto.llm import exact_dedup, fuse, imatch, line_dedup, minhash, mixing, queries, sharding, toxicity
from savanto.llm.components import components
from tests.llm.data import no_docs, odd_docs, odd_rows, unique_docs

# ---- exact duplicates ----


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 8192])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, np.uint64)
    made = fuse.build(keys)
    assert fuse.contains(made, keys).all()
    assert fuse.contains(made, rng.integers(0, 1 << 63, 100_000, np.uint64)).mean() < 0.008


def weak(text):
    """A digest of one byte: most texts clash."""
    return F.unhex(F.substring(F.md5(text.cast("binary")), 1, 2))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
@pytest.mark.parametrize("split", [0, 1, 2])
def test_exact_classes(spark, digest, split):
    docs = odd_docs(spark)
    stored = [None, F.lit(True), exact_dedup.earlier_half(docs)][split]
    groups = collections.defaultdict(list)
    for i, t in odd_rows():
        groups[t or ""].append(i)
    want = collections.Counter()
    for ids in groups.values():
        last = max((i for i in ids if i is not None), default=None)
        want.update((i, last, len(ids), i == last) for i in ids)
    got = exact_dedup.classes(docs, stored, digest).select("doc_id", "keep_id", "group_size", "kept")
    assert collections.Counter(map(tuple, got.collect())) == want


def test_texts_to_compare_move_alike_at_any_size(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(40)], "doc_id bigint, text string")
    groups = exact_dedup.grouped(docs.select("doc_id", exact_dedup.sha256(F.col("text")).alias("digest")))
    differ = exact_dedup._texts_differ(docs, groups, exact_dedup.sha256)
    plan = differ._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in next(x for x in plan.split("\n") if "SortMergeJoin" in x)  # few groups are not broadcast
    assert differ.count() == 0


def test_exact_deduplicated(spark):
    docs = odd_docs(spark)
    out = exact_dedup.deduplicated(docs, exact_dedup.earlier_half(docs))
    assert out.columns == docs.columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in odd_rows()})
    empty = no_docs(spark)
    assert exact_dedup.deduplicated(empty, exact_dedup.earlier_half(empty)).count() == 0


# ---- near duplicates ----


def words_of(text):
    return text.encode().lower().split()


def brute_components(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        n = min(words, len(w))
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if n else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if not sets[a] or not sets[b]:
            continue
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80), (1, 60)])
def test_near_duplicates(spark, monkeypatch, words, percent):
    docs, texts = unique_docs(spark)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 5)  # groups fall into several blocks
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, minhash.Likeness(words, percent)).collect()}
    assert got == brute_components(texts, words, percent)


def test_a_chain_of_near_duplicates_is_one_component(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(30):  # each differs from the one before by two words
        texts[i] = " ".join(words)
        words[i * 3] = f"x{i}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = minhash.near_duplicates(docs, minhash.Likeness(3, 85)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 30
    assert {r.component_id for r in got} == {v[1] for v in brute_components(texts, 3, 85).values()}


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows())
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id in range(100, 112)} == {100}
    assert {r.component_id for r in got if r.doc_id in {3, *range(200, 209)}} == {3}
    assert all(r.kept for r in got if r.doc_id in {300, 301, 302, 303, 304, 305})
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == sum(r.kept for r in got)
    assert minhash.near_duplicates(no_docs(spark)).count() == minhash.deduplicated(no_docs(spark)).count() == 0


def test_needed_coordinates():
    assert minhash.Likeness(3, 85).needed == 39 and minhash.Likeness(5, 80).needed == 34
    assert minhash.Likeness(3, 100).needed == 64


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(50)]
    root = {x: x for p in links for x in p}
    for _ in range(400):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: c for x, c in root.items() if any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- line runs ----


def brute_lines(rows, lines, words):
    rows = sorted({(i, t or "") for i, t in rows}, key=lambda r: r[0])
    seen, out = set(), {}
    for i, text in rows:
        kept = [(k, s) for k, line in enumerate(text.split("\n")) if (s := line.strip(" \t\r"))]
        gone = set()
        runs = [(k, k, ("long", s)) for k, s in kept if len(s.split(" ")) >= words]
        runs += [(kept[j][0], kept[j + lines - 1][0], tuple(s for _, s in kept[j : j + lines])) for j in range(len(kept) - lines + 1)]
        for first, last, run in sorted(runs):
            if run in seen:
                gone.update(range(first, last + 1))
            seen.add(run)
        left = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
        out[i] = (len(kept), sum(k in gone for k, _ in kept), left)
    return out


@pytest.mark.parametrize("lines, words", [(2, 50), (2, 5), (3, 12), (1, 9), (2, 1)])
def test_line_runs(spark, lines, words):
    rng = random.Random(lines)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 3, 5, 12, 49]))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  ", f"own {i} {k}"]) for k in range(rng.randint(0, 25)))) for i in range(60)]
    shared = "\n".join(pool[:6])
    rows += [(60 + i, f"intro {i}\n{shared}\n\nend {i}") for i in range(5)] + [(70, "x\nx\nx\nx"), (71, None), (72, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.clean_text) for r in line_dedup.deduplicated(docs, line_dedup.Runs(lines, words)).collect()}
    assert got == brute_lines(rows, lines, words)


def test_line_runs_of_odd_rows(spark):
    docs = odd_docs(spark)
    out = line_dedup.deduplicated(docs)
    assert out.count() == len(odd_rows()) and set(docs.columns) <= set(out.columns)
    again = [r.clean_text for r in out.where("doc_id = 5").collect()]
    assert len(again) == 3 and len(set(again)) == 1  # wholly repeated rows are one document
    assert line_dedup.deduplicated(no_docs(spark)).count() == 0


# ---- fingerprints ----


def test_edited_texts_and_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET", 7)
    docs, texts = unique_docs(spark)
    rows = imatch.edit_test(docs).collect()
    order = sorted(texts, reverse=True)
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert by[i].n_chars == len(text) and by[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
        if changed == text:
            assert by[i].fingerprint == by[i].edited_fingerprint and by[i].near_edited == 1
        nxt = by[order[(k + 1) % len(order)]]
        if by[i].fingerprint == nxt.fingerprint:
            assert by[i].near_next == 1
    prints = collections.defaultdict(set)
    for i, t in texts.items():
        prints[t].add(by[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    plain = {i for i in texts if 5 <= len(words_of(texts[i]))}
    assert np.mean([by[i].near_edited for i in plain]) > 0.05


def test_likeness_counts_filled_slots(spark):
    rows = spark.createDataFrame([([1, None, 3, None], [1, None, 4, 5])], "a array<int>, b array<int>")
    assert rows.select(imatch.likeness(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(1 / 3)


def test_documents_without_lexicon_terms_agree_in_part(spark):
    a = " ".join(f"word{i}" for i in range(60))
    rows = [(1, a, a.replace("word7 ", "other ")), (2, a, " ".join(f"far{i}" for i in range(60))), (3, a, a.upper()), (4, "", "..."), (5, "", a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, second string")
    none = imatch.lexicon(docs).where("false")
    found = imatch.fingerprints(docs, none, ["doc_id"], {"a": "text", "b": "second"})
    got = {r.doc_id: r for r in found.select("*", imatch.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    assert 0.8 < got[1].x < 1 and [got[i].x for i in (2, 3, 4, 5)] == [0, 1, 1, 0]
    assert got[1].a[0] != got[1].b[0] and len(got[1].a) == imatch.SLOTS


def test_lexicon_band(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 5} rare{i}") for i in range(40)], "doc_id bigint, text string")
    band = imatch.lexicon(docs, 0.05, 0.5)
    assert band.count() == 5 and band.where(F.col("entries")[0] == F.col("term").bitwiseAND(F.lit((1 << imatch.TERM_BITS) - 1))).count() == 5


def test_fingerprints_of_odd_rows(spark):
    assert imatch.edit_test(odd_docs(spark).select("doc_id", "text", "place")).count() == len(odd_rows())
    assert imatch.edit_test(no_docs(spark)).count() == 0
    one = spark.createDataFrame([(1, "abcdef ghij")], "doc_id bigint, text string")
    assert imatch.edit_test(one).first().near_next == 1.0


# ---- shards ----


def test_lookup_takes_turns():
    shards = [f"s{i}" for i in range(7)]
    owner = sharding.lookup(shards, 101)
    sizes = collections.Counter(owner)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup(shards[:-1], 101)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 6)
    assert moved < 30  # most slots of the others stay
    for bad in ((shards, 100), ([], 7), (["a", "a"], 7), (shards, 5)):
        with pytest.raises(ValueError):
            sharding.lookup(*bad)


def test_placement(spark):
    shards = ["a", "b", "c"]
    docs = odd_docs(spark)
    out = sharding.place(docs, "doc_id", shards, 31)
    assert out.count() == len(odd_rows()) and set(docs.columns) <= set(out.columns)
    owner = sharding.lookup(shards, 31)
    for r in out.select("doc_id", "slot", "shard").collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == sharding.number(key) % 31 and r.shard == shards[owner[r.slot]]
    assert sharding.place(no_docs(spark), "doc_id", shards, 31).count() == 0


def test_shards_hold_whole_documents(spark, tmp_path):
    shards = ["01", "b", "c"]
    docs = odd_docs(spark)
    sharding.write_shards(docs, "doc_id", shards, 31, str(tmp_path / "shards"))
    back = sharding.read_shards(spark, str(tmp_path / "shards"), docs.schema)
    placed = sharding.place(docs, "doc_id", shards, 31)
    rows = lambda df: collections.Counter(tuple(r) for r in df.select(*placed.columns).collect())
    assert rows(back) == rows(placed)
    for s in shards:
        assert spark.read.parquet(str(tmp_path / "shards" / f"shard={s}")).count() == placed.where(F.col("shard") == s).count() > 0
    sharding.write_shards(no_docs(spark), "doc_id", shards, 31, str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none"), docs.schema).count() == 0


def test_sharding_query_writes_balanced_shards(spark):
    folder = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
    placed = queries.sharding_query(spark, folder)
    files = placed.inputFiles()
    assert {f.split("shard=")[1].split("/")[0] for f in files} == set(queries.SHARDS)
    written_ = spark.read.parquet(files[0].split("/shard=")[0])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert written_.select(docs.columns).exceptAll(docs).count() == 0 == docs.exceptAll(written_.select(docs.columns)).count()
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    mean = sum(sizes) / len(queries.SHARDS)
    assert max(sizes) - mean < 6 * mean**0.5 and mean - min(sizes) < 6 * mean**0.5


def test_placement_runs_without_python(spark):
    plan = sharding.place(odd_docs(spark, False), "doc_id", ["a", "b"], 31)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas", plan)


# ---- mixtures ----


@pytest.mark.parametrize("target", [mixing.Target(2.0), mixing.Target(1.2), mixing.Target(budget=3000), mixing.Target(entropy=1.0), mixing.Target(budget=10)])
def test_mixture(spark, monkeypatch, target):
    monkeypatch.setattr(mixing, "BLOCK", 6)
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "big" if i % 3 else rng.choice(["x", "y", None, "empty"])) for i in range(240)]
    rows = [(i, None if s == "empty" else t, s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("epoch", F.lit("clash"))
    got = mixing.mix(docs, target).select("doc_id", "source", "n_tokens", "epoch", "place").collect()
    size = {i: len(t.split(" ")) if t else 0 for i, t, _ in rows}
    tokens = collections.Counter()
    for i, _, s in rows:
        tokens[s] += size[i]
    live = [t for t in tokens.values() if t]
    quota = dict(zip([s for s, t in tokens.items() if t], mixing.quotas(live, mixing.exponent(live, target), target.budget)))
    passes = collections.defaultdict(list)
    for r in got:
        assert r.n_tokens == size[r.doc_id]
        passes[r.source, r.epoch].append(r)
    for s in tokens:
        mine = [r for r in got if r.source == s]
        ids = sorted(i for i, _, x in rows if x == s)
        if s not in quota:
            assert sorted(r.doc_id for r in mine) == ids
            continue
        used = sum(r.n_tokens for r in mine)
        assert quota[s] <= used <= quota[s] + 30 or used == 0 == quota[s]
        last = max((r.epoch for r in mine), default=0)
        for e in range(last + 1):
            order = sorted(passes[s, e], key=lambda r: r.place)
            assert len({r.doc_id for r in order}) == len(order)
            assert [r.place for r in order] == sorted({r.place for r in order})
            if e < last:
                assert sorted(r.doc_id for r in order) == ids and [r.place for r in order] == list(range(len(ids)))
    if target.budget is None:
        assert {r.doc_id for r in got} == {i for i, _, _ in rows}


def test_exponent():
    tokens = [700, 200, 100]
    e = mixing.exponent(tokens, mixing.Target(repeats=1.5))
    w = mixing.weights(tokens, e)
    repeats = [x / t * max(t / y for t, y in zip(tokens, w)) for x, t in zip(w, tokens)]
    assert max(repeats) == pytest.approx(1.5) and 0 < e < 1
    h = lambda w: -sum(x * math.log(x) for x in w)
    e = mixing.exponent(tokens, mixing.Target(entropy=1.0))
    assert h(mixing.weights(tokens, e)) == pytest.approx(1.0)
    assert mixing.exponent(tokens, mixing.Target(entropy=0.1)) == 1.0 and mixing.exponent(tokens, mixing.Target(entropy=9.0)) == 0.0
    assert mixing.exponent([5, 5], mixing.Target(repeats=1.0)) == 0.0


def test_mixture_of_very_many_sources(spark):
    docs = spark.range(100_001).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', 'a b') as text", "string(id) as source")
    got = mixing.mix(docs, mixing.Target(repeats=1.0)).groupBy("epoch").count().collect()
    assert [tuple(r) for r in got] == [(0, 100_001)]


def test_mixture_of_odd_rows(spark):
    docs = odd_docs(spark)
    out = mixing.mix(docs)
    assert set(docs.columns) <= set(out.columns)
    assert collections.Counter(r.doc_id for r in out.where("epoch = 0").collect()) == collections.Counter(i for i, _ in odd_rows())
    assert mixing.mix(no_docs(spark)).count() == 0


# ---- toxicity ----


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        words = [rng.choice("the sun rises over green hills while birds sing and rivers run to sea".split()) for _ in range(rng.randint(8, 60))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "you idiot", "M0RON"]))
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_toxicity_of_held_out_rows(spark, labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).select("doc_id", "score", "predicted", toxicity.held_out().alias("held")).collect()
    held = [r for r in got if r.held]
    assert 150 < len(held) < 300 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    odd = toxicity.score(odd_docs(spark), model)
    assert odd.count() == len(odd_rows()) and odd.where("score is null or predicted is null").count() == 0
    assert set(odd_docs(spark).columns) == set(odd.columns)
    assert toxicity.score(no_docs(spark), model).count() == 0


def test_toxicity_without_labels(spark, labelled):
    docs, labels, _ = labelled
    for some in (labels.where("false"), labels.where("toxic = 1")):
        scores = {r.score for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()}
        assert scores in ({0.0}, {1.0})
    assert toxicity.fit(no_docs(spark), labels).trees is None


def test_features(spark):
    lexicon = toxicity.Lexicon(("moron",), ("vequ",), 4)
    rows = spark.createDataFrame([("You, MORON!! vequ vequaa m0ron aaa",), ("",), (None,)], "text string")
    out, names = toxicity.features(rows, lexicon)
    first, empty, null = [r.asDict() for r in out.select(*names).collect()]
    assert first["__f_lexicon_density"] == pytest.approx(1 / 6) and first["__f_beginning_density"] == pytest.approx(1 / 6)
    assert first["__f_disguised_hits"] > 0 and first["__f_second_person_near"] > 0 and first["__f_shouted_words"] == pytest.approx(1 / 6)
    assert set(empty.values()) == {0.0} and empty == null
