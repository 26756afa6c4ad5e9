"""The hash index: exact answers, few stored bytes read, appends that keep filter and hashes together."""

import pytest
from pyspark.sql import functions as F

from daftar.operators import dedup
from daftar.sources import hash_index


def hashed(spark, first, last, step=1):
    return spark.range(first, last, step).select(F.col("id").alias("chunk_id"), F.md5(F.col("id").cast("string")).alias("content_hash"))


def parts(spark, path, kind):
    return [r for r in hash_index.manifest(spark, path) if r["kind"] == kind]


@pytest.fixture()
def index(spark, tmp_path):
    path = str(tmp_path / "index")
    hash_index.create(hashed(spark, 0, 20_000), path, buckets=16)
    return path


def test_same_as_the_join_with_the_store(spark, index):
    new = hashed(spark, 19_900, 20_300).unionByName(
        spark.createDataFrame([(-1, None), (-2, None), (-3, "only once"), (-4, "only once")], "chunk_id long, content_hash string"))
    got = hash_index.unseen(new, index).collect()
    want = dedup.dedup_against_store(new, hashed(spark, 0, 20_000)).select(*new.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) == 303


def test_few_of_the_stored_bytes_are_read(spark, index):
    told = {}
    assert hash_index.unseen(hashed(spark, 50_000, 60_000), index, told=told).count() == 10_000
    assert told["stored"] == 0 and told["hits"] < 150  # false positives, settled on the stored hashes
    told = {}
    hash_index.unseen(hashed(spark, 7, 9), index, told=told)
    assert told["hits"] == told["stored"] == 2 and told["buckets"] <= 2
    assert told["bytes_read"] < told["bytes_stored"] / 3
    told = {}
    new = hashed(spark, 90_000, 90_001)
    out = hash_index.unseen(new, index, told=told)
    assert out.count() == 1 and told["buckets"] == told["hits"] == 0


def test_appends(spark, index):
    hash_index.append(hashed(spark, 20_000, 25_000), index, batch="b1")
    hash_index.append(hashed(spark, 20_000, 25_000), index, batch="b1")  # a retry
    assert len(parts(spark, index, "hashes")) == 2 and len(parts(spark, index, "blocks")) == 2
    for i in range(12):
        hash_index.append(hashed(spark, 30_000 + 10 * i, 30_010 + 10 * i), index)
    assert len(parts(spark, index, "blocks")) <= hash_index.PARTS
    assert hash_index.unseen(hashed(spark, 0, 30_130), index).count() == 5_010
    blocks = parts(spark, index, "blocks")[0]["blocks"]
    hash_index.append(hashed(spark, 100_000, 140_000), index)  # more than the filter was laid for
    (grown,) = parts(spark, index, "blocks")
    assert grown["blocks"] > blocks and grown["hashes"] == 65_120
    told = {}
    assert hash_index.unseen(hashed(spark, 120_000, 150_000), index, told=told).count() == 10_000
    assert told["stored"] == 20_000 and told["hits"] < 20_150


def test_a_version_is_not_taken_twice(spark, index):
    with pytest.raises(RuntimeError):
        hash_index._publish(spark, index, 0, [("hashes", "x", None, 0, 1, 0)])
    assert parts(spark, index, "hashes")[0]["hashes"] == 20_000


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    hash_index.create(hashed(spark, 0, 0), path)
    assert hash_index.unseen(hashed(spark, 0, 3), path).count() == 3
    hash_index.append(hashed(spark, 0, 2), path)
    assert hash_index.unseen(hashed(spark, 0, 3), path).count() == 1
    assert hash_index.unseen(hashed(spark, 0, 0), path).count() == 0
