"""The queries without SQL, on whole tables, against plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from savanto.llm import vocabulary
from savanto.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = vocabulary.library(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in docs.items()}


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}


def test_token_counts(spark, docs, ids):
    got = rows(spark, "op1_token_counts")
    want = {i: (len(docs[i].encode()), len(x), len(x) > 1024) for i, x in ids.items()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == want


def test_token_files(spark, ids):
    start, want = 0, {}
    for i in sorted(ids):
        all_ = np.array([*ids[i], 0], "<u4")
        want[i] = (start, len(all_), zlib.crc32(all_.tobytes()))
        start += len(all_)
    assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in rows(spark, "op3_token_files").items()} == want


def test_bpe(spark, docs, ids):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    tokenizer = vocabulary.library(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(x), digest(",".join(map(str, x))), digest(tokenizer.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in rows(spark, "op9_bpe").items()} == want


def test_imatch(spark, docs):
    got = rows(spark, "op5_imatch")
    order = sorted(docs, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        text, half = docs[i], len(docs[i]) // 2
        edited = text[: len(text) - half] + docs[following][:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == got[following].fingerprint) == (r.near_next == 1)
        if edited == text:
            assert r.near_edited == 1
    by_text = {}
    for i, text in docs.items():
        assert by_text.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    assert len(got) == len(docs)


@pytest.mark.parametrize("name, threshold", [("op6_toxicity", 0.3), ("op12_quality", 0.7)])
def test_scores(spark, docs, name, threshold):
    got = rows(spark, name)
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
