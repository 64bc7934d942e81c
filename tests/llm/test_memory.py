"""Workers outlive their tasks: what a task frees has to leave the process."""

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from savanto.llm import bpe, common, phrases, vocabulary


def resident() -> int:
    with open("/proc/self/status") as file:
        return next(int(line.split()[1]) for line in file if line.startswith("VmRSS")) << 10


def test_freed_memory_goes_back_to_the_system():
    held = [bytearray(3000) for _ in range(50_000)]
    last = bytearray(3000)  # the end of the heap stays in use
    full = resident()
    del held
    common.give_back()
    assert len(last) and resident() < full - (100 << 20)


def test_memory_is_given_back_after_every_batch_and_shard(monkeypatch):
    calls = []
    for module in (common, phrases):
        monkeypatch.setattr(module, "give_back", lambda: calls.append(1))
    assert [s.num_rows for s in common.slices(pa.RecordBatch.from_pydict({"text": ["a b", ""]}))] == [2]
    assert len(calls) == 1
    index = phrases.WordIndex.build(phrases.word_ids(b"a b. a b")[1], 3, 3)
    row = {"shard": [7], "lang": ["en"], "words": [b"a\nb"], "forward": [phrases._planes(index.forward)], "reverse": [phrases._planes(index.reverse)]}
    shards = [pa.RecordBatch.from_pydict(row)] * 2
    told = list(phrases._screener(phrases.Rule(least=2), phrases.Ranges(1), 48)(iter(shards)))
    assert [t.column("shard").to_pylist() for t in told] == [[7], [7]] and len(calls) == 3


def test_encoding_workers_hold_words_only():
    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe.encoder.cache_clear()
    memory = bpe.encoder(path).memory
    assert vocabulary.library.cache_info().currsize == 0
    memory.of([" great", " great,", " great.", "\n", " 5,5"])
    assert set(memory.known) == {" great"} and set(memory.whole) == {" 5,5"}


def test_the_encoding_takes_small_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b " * 250_000) for i in range(4)], "doc_id long, text string").coalesce(1)
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == 4
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == corpus_pipeline.BATCH_BYTES
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) < 4
