"""The keyed store: only touched buckets are rewritten, versions switch at once, retries leave one version."""

import pytest
from pyspark.sql import functions as F

from daftar.sources import keyed_store, stores

KEY, BY = ["k"], ["v"]
KIND = "k long, v int, x string"


@pytest.fixture()
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(i, 1, f"old{i}") for i in range(500)] + [(7, 0, "older"), (None, 1, "keyless"), (None, 1, "keyless")]
    keyed_store.create(spark.createDataFrame(rows, KIND), path, KEY, BY, buckets=16)
    return path


def rows(spark, path, version=None):
    return sorted((tuple(r) for r in keyed_store.read(spark, path, version).collect()), key=str)


def folders(spark, path):
    return {r["bucket"]: r["folder"] for r in keyed_store.manifest(spark, path).collect()}


def test_few_keys_rewrite_few_buckets(spark, store):
    before, was = folders(spark, store), rows(spark, store)
    new = spark.createDataFrame([(3, 2, "new"), (4, 0, "too old"), (5, 1, "same version"), (3, 1, "older new"), (900, 1, "added"), (None, 9, "free")], KIND)
    touched = keyed_store.upsert(new, store, KEY, BY)
    after = folders(spark, store)
    assert 0 < len(touched) <= 5 and {b for b in after if after[b] != before[b]} == touched
    want = {(i, 1, f"old{i}") for i in range(500)} - {(3, 1, "old3"), (5, 1, "old5")} | {(3, 2, "new"), (5, 1, "same version"), (900, 1, "added"), (None, 9, "free")}
    assert rows(spark, store) == sorted([*want, (None, 1, "keyless"), (None, 1, "keyless")], key=str)
    assert rows(spark, store, 0) == was  # a reader of the old version is not disturbed


def test_same_as_upsert_in_memory(spark, store):
    new = spark.range(0, 700, 3).select(F.col("id").alias("k"), (F.col("id") % 3 + F.col("id") % 2).cast("int").alias("v"), F.lit("n").alias("x"))
    want = stores.upsert(new, keyed_store.read(spark, store), KEY, [F.col("v").desc()])
    want = sorted((tuple(r) for r in want.select("k", "v", "x").collect()), key=str)
    keyed_store.upsert(new, store, KEY, BY)
    assert rows(spark, store) == want


def test_a_named_batch_is_applied_once(spark, store):
    new = spark.createDataFrame([(1, 5, "a"), (None, 5, "free")], KIND)
    assert keyed_store.upsert(new, store, KEY, BY, batch="b1")
    once = rows(spark, store)
    assert keyed_store.upsert(new, store, KEY, BY, batch="b1") == set()
    assert rows(spark, store) == once and len(keyed_store.versions(spark, store)) == 2


def test_a_try_that_died_leaves_the_old_version(spark, store, monkeypatch):
    was = rows(spark, store)
    publish = keyed_store._publish

    def dies(*args):
        raise OSError("executor lost")

    monkeypatch.setattr(keyed_store, "_publish", dies)
    new = spark.createDataFrame([(1, 5, "a")], KIND)
    with pytest.raises(OSError):
        keyed_store.upsert(new, store, KEY, BY, batch="b1")
    assert rows(spark, store) == was
    monkeypatch.setattr(keyed_store, "_publish", publish)
    keyed_store.upsert(new, store, KEY, BY, batch="b1")
    assert (1, 5, "a") in rows(spark, store) and len(rows(spark, store)) == len(was)


def test_two_writers(spark, store):
    manifest = [tuple(r) for r in keyed_store.manifest(spark, store).collect()]
    keyed_store._publish(spark, store, 1, manifest)
    with pytest.raises(RuntimeError):
        keyed_store._publish(spark, store, 1, manifest)
    assert keyed_store.versions(spark, store) == [0, 1]


def test_stored_rows_are_not_shuffled(spark, store, capsys):
    """Beside a few new rows, the stored side of the join has no exchange."""
    old = keyed_store.read(spark, store).withColumn("_bucket", F.lit(0))
    new = spark.createDataFrame([(1, 5, "a", 0)], KIND + ", _bucket int")
    out = keyed_store.merged(old, new, KEY, BY)
    out.collect()
    out.explain()
    final = capsys.readouterr().out.split("Initial Plan")[0]
    assert "hashpartitioning(k" not in final.split("BroadcastHashJoin")[0]
    assert "BroadcastHashJoin" in final


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    none = spark.createDataFrame([], KIND)
    keyed_store.create(none, path, KEY, BY, buckets=4)
    assert keyed_store.upsert(none, path, KEY, BY) == set()
    keyed_store.upsert(spark.createDataFrame([(1, 1, "a")], KIND), path, KEY, BY)
    assert rows(spark, path) == [(1, 1, "a")]
