"""Token counts, token files and BPE against the library."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from savanto.llm import bpe, token_counts, token_files, vocabulary
from savanto.session import new_path
from tests.llm.data import no_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(text):
    return vocabulary.library(PATH).encode(text or "", add_special_tokens=False).ids


def flat(encoder, texts):
    ids, ends = encoder.flat(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


LETTERS = "ab \n\t'<|>.,é中\U0001f600\x1c\x1d\x85 　012٣​\xa0 \x00sSt"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=30) | st.text(max_size=20) | st.sampled_from(["<|endoftext|>", "aaaa aaaaa", "the  the"]), max_size=8))
def test_both_encoders_give_the_librarys_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [library_ids(t) for t in texts]
    assert flat(vocabulary.library_encoder(PATH), texts) == want
    assert flat(bpe.encoder(PATH), texts) == want


def test_compatible_pairs_are_those_that_encode_as_themselves():
    merges, rng = bpe.merges(PATH), random.Random(2)
    letters = {i: t for t, i in merges.ids.items()}
    model = vocabulary.library(PATH).model
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        want = [t.id for t in model.tokenize(letters[a] + letters[b])] == [a, b]
        assert merges.compatible(a, b) == want


def test_memory_forgets_and_stretches_join(monkeypatch):
    monkeypatch.setattr(vocabulary, "STRETCH", 50)
    encoder = vocabulary.text_encoder(PATH, bpe.merges(PATH).encode)
    encoder.memory.size = 5
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "cd\n", "efgh", "  "]) + str(rng.randrange(50)) for _ in range(n)) for n in (0, 3, 90, 400, 7)] * 3
    assert flat(encoder, texts) == [library_ids(t) for t in texts]
    assert "".join(vocabulary.stretches(texts[3], 50)) == texts[3]


def test_counts(spark):
    cache = new_path(spark, "cache")
    want = collections.Counter((i, len((t or "").encode()), len(library_ids(t))) for i, t in odd_rows())
    for _ in range(2):  # the second time all counts come from the cache
        got = token_counts.count_tokens(odd_docs(spark), cache, PATH)
        assert collections.Counter(map(tuple, got.collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == len({t or "" for _, t in odd_rows()})
    assert token_counts.count_tokens(no_docs(spark), cache, PATH).count() == 0


def test_only_misses_are_encoded(spark):
    cache, version = new_path(spark, "cache"), vocabulary.version(PATH)
    token_counts.open_cache(spark, cache)
    known = hashlib.sha256(b"one").digest()
    rows = [(bytearray(known), 77, version), (bytearray(known), 5, "another version")]
    spark.createDataFrame(rows, token_counts.CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, cache, PATH).collect()}
    assert got == {1: 77, 2: 1}


@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    ids[::7] %= 3
    packed = token_files.pack(ids)
    assert (token_files.unpack(packed, n) == ids).all()
    for first, last in ((0, n), (n // 3, n // 2), (n, n)):
        assert (token_files.unpack(packed, n, first, last) == ids[first:last]).all()


def test_outliers_are_patched():
    ids = np.arange(128, dtype=np.uint32) % 4
    ids[5] = 50_000
    packed = token_files.pack(ids)
    assert packed["widths"] == b"\x02" and len(packed["payload"]) == 32 and packed["patch_places"] == b"\x05"


def test_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    folder = new_path(spark, "ids")
    token_files.write_ids(odd_docs(spark), folder, PATH)
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*library_ids(t), 0], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read_ids(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.segments(spark, folder).count() > 5
    empty = new_path(spark, "ids")
    token_files.write_ids(no_docs(spark), empty, PATH)
    assert token_files.read_ids(spark, empty).count() == 0


def test_encode_and_decode(spark):
    docs = odd_docs(spark)
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == [*[c for c in docs.columns if c != "ids"], "ids"]
    got = bpe.decode(encoded, PATH).select("doc_id", "text", "ids", "decoded", "score").collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r.ids == library_ids(r.text) and r.decoded == (r.text or "") and r.score == "clash"
    digests = {tuple(r) for r in bpe.digests(bpe.decode(encoded, PATH)).collect()}
    text = odd_rows()[0][1]
    ids = ",".join(map(str, library_ids(text)))
    assert (0, len(library_ids(text)), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) in digests
    at_once = bpe.digests(bpe.encode(docs, PATH, keep=["doc_id"], decoded="decoded"))
    assert {tuple(r) for r in at_once.collect()} == digests
    assert bpe.decode(bpe.encode(no_docs(spark), PATH), PATH).count() == 0


def test_decoding_broken_characters_and_null_lists(spark):
    rng = random.Random(5)
    lists = [[rng.randrange(50257) for _ in range(6)] for _ in range(200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, [], None])], "i int, ids array<int>")
    got = {r.i: r.decoded for r in bpe.decode(rows, PATH).collect()}
    want = vocabulary.library(PATH).decode_batch(lists, skip_special_tokens=False)
    assert [got[i] for i in range(202)] == [*want, "", ""]


def test_pieces_with_line_ends_are_cut_without_the_library():
    memory, cut = vocabulary.text_encoder(PATH, bpe.merges(PATH).encode).memory, []
    memory.split = lambda piece: cut.append(piece) or []
    (ids,) = memory.of([" word.\nOther"])
    assert not cut and np.frombuffer(ids, "<u4").tolist() == library_ids(" word.\nOther")
