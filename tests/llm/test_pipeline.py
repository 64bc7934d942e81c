"""The pipeline stage by stage against brute force, on odd documents."""

import collections
import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from savanto.llm import mixing, vocabulary
from savanto.llm.queries import QUERIES, SQL
from savanto.session import new_path, written
from tests.llm.data import no_docs, odd_docs, unique_docs
from tests.llm.test_documents import brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = {i: f"{'calm words on a quiet road ' * (i % 4 + 2)} you moron scum {i}" for i in range(1000, 1080)}
CALM = {i: f"{'calm words on a quiet road ' * (i % 4 + 2)} and more {i} of it" for i in range(1100, 1260)}


@pytest.fixture(scope="module")
def folder(spark):
    docs, _ = unique_docs(spark)
    more = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in {**TOXIC, **CALM}.items()]
    labels = [(i, 1, int(i in TOXIC)) for i in {**TOXIC, **CALM}]
    path = new_path(spark, "pipeline-test")
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], folder)
        kept.append(written(out, "stage"))
    assert all(k.columns == COLUMNS for k in kept[:-1])
    rows = [k.collect() for k in kept]

    ids = [{r.doc_id for r in x} for x in rows]
    assert not ids[1] & set(TOXIC) and len(ids[1] & set(CALM)) >= 0.98 * len(CALM)
    assert len(ids[0] - set(TOXIC) - ids[1]) <= 3

    groups = collections.defaultdict(list)
    for r in rows[1]:
        groups[r.text or ""].append(r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(max(g) for g in groups.values())

    near = brute_components({r.doc_id: r.text or "" for r in rows[2]}, 5, 80)
    assert sorted(r.doc_id for r in rows[3]) == sorted(i for i, (_, _, stays) in near.items() if stays)

    times = collections.Counter(r.doc_id for r in rows[4])
    assert set(times) == ids[3]
    tokens = collections.Counter()
    for r in rows[3]:
        tokens[r.source] += len(r.text.split(" ")) if r.text else 0
    quota = mixing.quotas(list(tokens.values()), mixing.exponent(list(tokens.values()), corpus_pipeline.MIXTURE), None)
    used = collections.Counter()
    for r in rows[4]:
        used[r.source] += len(r.text.split(" ")) if r.text else 0
    longest = max(len((r.text or "").split(" ")) for r in rows[3])
    assert all(q <= used[s] <= q + longest for s, q in zip(tokens, quota))

    library = vocabulary.library(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = collections.Counter()
    for r in rows[4]:
        found = library.encode(r.text or "", add_special_tokens=False).ids
        text = (r.text or "").encode()
        want[r.doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows[5])) == want


def test_stages_on_odd_and_no_rows(spark, folder):
    odd = odd_docs(spark, clashing=False)
    for _, stage in corpus_pipeline.STAGES[1:]:
        odd = written(stage(spark, odd, folder), "stage")
    assert odd.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark).select(COLUMNS), folder).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
    assert set(SQL) <= set(QUERIES)
