"""Bucket stores, manifests and compacted deltas: what changes, what stays, and what a stop leaves behind."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from savanto.operators.bucket_store import BucketStore
from savanto.session import new_path
from savanto.sources import manifest
from savanto.streaming.compaction import BATCH, Deltas

ROWS = "id bigint, value string, ts bigint"


def rows(spark, ids, value, ts):
    return spark.createDataFrame([(i, value, ts) for i in ids], ROWS)


def content(df):
    return {r.id: (r.value, r.ts) for r in df.collect()}


@pytest.fixture
def store(spark):
    made = BucketStore(new_path(spark, "store"), ("id",), 16)
    made.create(rows(spark, range(200), "a", 1))
    return made


def test_only_touched_buckets_are_written(spark, store):
    before = store.folders(spark)
    touched = store.upsert(rows(spark, [3, 500], "b", 2), "ts")
    after = store.folders(spark)
    assert 1 <= len(touched) <= 2
    assert {b for b in after if after[b] != before.get(b)} == set(touched)
    assert content(store.read(spark)) == {i: ("a", 1) for i in range(200)} | {3: ("b", 2), 500: ("b", 2)}
    assert content(store.read(spark, 1)) == {i: ("a", 1) for i in range(200)}


def test_latest_wins_also_against_the_table(spark, store):
    store.upsert(rows(spark, [1], "old", 0).unionByName(rows(spark, [2], "x", 5)).unionByName(rows(spark, [2], "y", 7)), "ts")
    assert content(store.read(spark))[1] == ("a", 1) and content(store.read(spark))[2] == ("y", 7)
    assert store.upsert(rows(spark, [], "", 0), "ts") == []


def test_a_run_that_fails_changes_nothing(spark, store):
    before, folders = content(store.read(spark)), store.folders(spark)
    with pytest.raises(Exception):
        store.upsert(rows(spark, [1], "b", 2).withColumn("value", F.raise_error(F.lit("stop"))), "ts")
    assert content(store.read(spark)) == before and store.folders(spark) == folders
    # what it left behind is swept
    store.sweep(spark)
    assert content(store.read(spark)) == before


def test_of_two_writers_one_fails(spark, store, monkeypatch):
    state = store._state(spark)
    store.upsert(rows(spark, [1], "first", 2), "ts")
    monkeypatch.setattr(BucketStore, "_state", lambda self, spark: state)
    with pytest.raises(Exception):
        store.upsert(rows(spark, [1], "second", 3), "ts")
    monkeypatch.undo()
    assert content(store.read(spark))[1] == ("first", 2)


def test_sweep_keeps_recent_versions(spark, store):
    for n in range(3):
        store.upsert(rows(spark, range(10), f"v{n}", 2 + n), "ts")
    assert store.sweep(spark, keep=2)
    assert content(store.read(spark))[0] == ("v2", 4) and content(store.read(spark, 3))[0] == ("v1", 3)
    assert store.sweep(spark, keep=2) == []


def test_lookup_opens_the_buckets_of_its_keys(spark, store):
    found = store.lookup(spark.createDataFrame([(7,), (7,), (9999,)], "id bigint"))
    assert content(found) == {7: ("a", 1)}
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) <= 2


def test_manifest_numbers_are_given_once(spark):
    folder = new_path(spark, "manifest")
    assert manifest.latest(spark, folder) is None
    manifest.publish(spark, folder, 1, {"a": 1})
    manifest.publish(spark, folder, 2, {"a": 2})
    with pytest.raises(Exception):
        manifest.publish(spark, folder, 2, {"a": 3})
    assert manifest.latest(spark, folder) == (2, {"a": 2}) and manifest.read(spark, folder, 1) == {"a": 1}
    assert not [n for n in manifest.names(spark, folder) if n.endswith(".draft")]


def newest(df):
    return df.groupBy("id").agg(F.max_by(F.struct("value", "ts", BATCH), "ts").alias("r")).select("id", "r.*")


@pytest.fixture
def deltas(spark):
    return Deltas(new_path(spark, "deltas"), StructType.fromDDL(ROWS), newest, every=3)


def test_a_reader_opens_few_folders(spark, deltas):
    want = {}
    for n in range(14):
        deltas.write(rows(spark, range(n, n + 4), f"v{n}", n), n)
        want |= {i: (f"v{n}", n) for i in range(n, n + 4)}
        assert len(deltas.folders(spark)) <= deltas.every + 2
        assert content(deltas.read(spark)) == want  # before, during and after a compaction
    stored = [n for n in manifest.names(spark, f"{deltas.path}/deltas") if n.isdigit()]
    assert len(stored) <= 2 * deltas.every + 1 and len(manifest.names(spark, f"{deltas.path}/snapshots")) <= 2


def test_a_stop_within_a_compaction_is_repeated(spark, deltas, monkeypatch):
    for n in range(2):
        deltas.write(rows(spark, [n], f"v{n}", n), n)
    real, want = manifest.publish, content(deltas.read(spark))

    def stop(*a):
        raise RuntimeError("stopped before the pointer")

    monkeypatch.setattr(manifest, "publish", stop)
    with pytest.raises(RuntimeError):
        deltas.compact(spark, 1)
    assert content(deltas.read(spark)) == want and len(deltas.folders(spark)) == 2
    monkeypatch.setattr(manifest, "publish", real)
    assert deltas.compact(spark, 1) and not deltas.compact(spark, 1)
    assert content(deltas.read(spark)) == want and len(deltas.folders(spark)) == 1
    assert len(manifest.names(spark, f"{deltas.path}/snapshots")) == 1  # that of the stop is gone


def test_a_batch_that_is_tried_again(spark, deltas):
    for n in range(3):  # the third one compacts the two before
        deltas.write(rows(spark, [1], f"v{n}", n), n)
    deltas.write(rows(spark, [1], "v2", 2), 2)
    assert content(deltas.read(spark)) == {1: ("v2", 2)}


def test_an_empty_table(spark, deltas):
    assert deltas.read(spark).count() == 0 and not deltas.compact(spark, 5)
