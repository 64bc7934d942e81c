"""The quality classifier: its features and solver against plain Python, and held-out labels."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from savanto.llm import quality, queries
from tests.llm.data import no_docs, odd_docs, odd_rows

FOLDER = "/root/testdata/sf0.01"


def plain_indicators(text, bits):
    """N-grams one at a time."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & mask
        x = ((x ^ (x >> 27)) * 0x81DADEF4BC2DD44D) & mask
        return x ^ (x >> 33)

    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    two = lambda a, b: mix((a * 0x9E3779B97F4A7C15 + b) & mask)
    word = [quality._hashes(w)[0] for w in words]
    form = [int(quality.AGAIN) if i and w == words[i - 1] else quality._hashes(w)[1] for i, w in enumerate(words)]
    grams = [mix(h) for h in word + form] + [two(a, b) for x in (word, form) for a, b in zip(x, x[1:], strict=False)]
    grams += [two(two(a, b), c) for a, b, c in zip(form, form[1:], form[2:], strict=False)]
    return sorted({g >> (64 - bits) for g in grams})


def test_indicators():
    texts = [t or "" for _, t in odd_rows()]
    keys, ends = quality.indicators(pa.array(texts), 18)
    for text, got in zip(texts, np.split(keys, ends[:-1]), strict=True):
        assert got.tolist() == plain_indicators(text, 18)
    assert [len(x) for x in quality.indicators(pa.array([], pa.string()), 18)] == [0, 0]


@pytest.mark.parametrize("word, form", [("Hello,", "Aa,"), ("HELLO!!!", "A!!"), ("x12***", "a0**"), ("éà", "a"), ("I", "Aa"), ("&&&", "&&")])
def test_shapes(word, form):
    assert quality.shape(word) == form


def test_ratios_by_hand():
    rows = [np.array([0, 1]), np.array([0]), np.array([0, 2]), np.array([2])]
    ratios = quality.log_count_ratios(rows, np.array([True, True, False, False]), quality.Training(bits=2))
    p, q = np.array([3, 2, 1, 1]) / 7, np.array([2, 1, 3, 1]) / 7
    assert np.allclose(ratios, np.where([1, 0, 1, 0], np.log(p / q), 0))


def test_solver_meets_the_optimum():
    """Primal and dual values of the problem agree, so the weights are those of the minimum."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(64, rng.integers(3, 12), replace=False)) for _ in range(200)]
    good = np.array([(r < 20).mean() + rng.normal(0, 0.2) > 0.35 for r in rows])
    training = quality.Training(bits=6, rounds=500, own=1.0, cost=1.0)
    ratios = quality.log_count_ratios(rows, good, training)
    w, bias = quality.support_vectors(rows, good, ratios, training)
    y, cost = np.where(good, 1, -1), np.where(good, 200 / (2 * good.sum()), 200 / (2 * (~good).sum()))
    outputs = np.array([w[r] @ quality._scaled(r, ratios) + bias for r in rows])
    primal = 0.5 * (w @ w + bias**2) + (cost * np.maximum(0, 1 - y * outputs)).sum()
    best = primal
    for _ in range(300):  # no step nearby is better
        dw, db = rng.normal(0, 0.01, 64), rng.normal(0, 0.01)
        o = np.array([(w + dw)[r] @ quality._scaled(r, ratios) + bias + db for r in rows])
        best = min(best, 0.5 * ((w + dw) @ (w + dw) + (bias + db) ** 2) + (cost * np.maximum(0, 1 - y * o)).sum())
    assert best > primal - 1e-3 * primal


def test_sigmoid_orders_and_bounds():
    a, b = quality.sigmoid_of(np.array([-2.0, -1, 0, 1, 2]), np.array([False, False, True, True, True]))
    assert a > 0 and 1 / (1 + np.exp(-(2 * a + b))) > 0.6
    assert np.isfinite(quality.sigmoid_of(np.zeros(4), np.array([True, False, True, False]))).all()


def test_query_on_held_out_labels(spark):
    rows = queries.quality_query(spark, FOLDER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.93 and len(held) > 50


def test_odd_documents(spark):
    docs = odd_docs(spark)
    labels = docs.where("doc_id is not null").select("doc_id", F.when(F.rand(1) < 0.1, F.lit(None)).otherwise((F.length("text") > 400).cast("int")).alias("quality"))
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert set(out.columns) == set(docs.columns) and out.count() == docs.count()
    scores = {}
    for r in out.collect():
        assert 0 <= r.score <= 1
        assert scores.setdefault(r.text or "", r.score) == r.score  # of the text alone
    assert quality.score(no_docs(spark), model).count() == 0


@pytest.mark.parametrize("labels, prior", [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, None), (2, 0)], 0.0)])
def test_without_both_labels(spark, labels, prior):
    model = quality.fit(odd_docs(spark), spark.createDataFrame(labels, "doc_id bigint, quality int"))
    assert {r.score for r in quality.score(odd_docs(spark), model).collect()} == {prior}
