"""A keyed table on files that an upsert changes in part.

Rows lie in hash buckets of their key.  A version is a manifest: one row per bucket with the
folder that holds it.  An upsert reads and rewrites the buckets that its keys fall into, in
folders of its own, and then puts a new manifest in place with one rename; readers see the old
version or the new one.  Untouched buckets stay where they are.

* The stored rows of the touched buckets are joined with the new rows' latest versions.  A few new
  rows are broadcast by adaptive execution after a look at their size, and no stored row is shuffled.
* A retried upsert names its ``batch``: if a manifest of that batch exists, nothing is done; a
  try that died before the rename has left a folder that no manifest names, and is repeated whole.
* Of two writers at once the second one's rename fails, and it has to try again.
* Rows with a null in the key equal nothing: they are added and never replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators.skew import any_null, keep_first

BUCKETS = 64


def at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    folder, files = at(spark, f"{path}/manifest")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit()) if files.exists(folder) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(bucket, folder, batch, buckets) of a version, the latest one by default: a row per bucket."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/manifest/{found[-1] if version is None else version}")


def _publish(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    draft = f"{path}/manifest/_{version}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, "bucket int, folder string, batch string, buckets int").coalesce(1).write.parquet(draft)
    source, files = at(spark, draft)
    target, _ = at(spark, f"{path}/manifest/{version}")
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)
        raise RuntimeError(f"version {version} of {path} was written meanwhile")


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, path: str, version: int) -> str:
    """Write rows (with ``_bucket``) to a folder of their own."""
    folder = f"data/{version}-{uuid.uuid4().hex}"
    rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    return folder


def _latest(rows: DataFrame, key: Sequence[str], version: Sequence[str], buckets: int) -> DataFrame:
    keyless = any_null(key)
    kept = keep_first(rows.filter(~keyless), key, [F.col(v).desc() for v in version]).unionByName(rows.filter(keyless))
    return kept.withColumn("_bucket", _bucket(key, buckets))


def create(rows: DataFrame, path: str, key: Sequence[str], version: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write a new store with the latest row of each key: the one with the largest ``version`` columns."""
    spark = rows.sparkSession
    folder = _written(_latest(rows, key, version, buckets), path, 0)
    _publish(spark, path, 0, [(b, folder, None, buckets) for b in range(buckets)])


def _folders(spark: SparkSession, path: str, rows: list, wanted: set[int]) -> list[str]:
    paths = [f"{path}/{r['folder']}/_bucket={r['bucket']}" for r in rows if r["bucket"] in wanted]
    return [p for p in paths if (lambda where, files: files.exists(where))(*at(spark, p))]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest one by default."""
    rows = manifest(spark, path, version).collect()
    found = _folders(spark, path, rows, {r["bucket"] for r in rows})
    if found:
        return spark.read.parquet(*found)
    return spark.read.parquet(f"{path}/{rows[0]['folder']}")  # no row at all: the writer left the schema


def merged(old: DataFrame, new: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Stored rows that no new row replaces, and new rows that no later stored row keeps out.

    Both sides have a key once.  The stored side is only filtered by what the
    join finds; it is not grouped or sorted.
    """
    key, keyless = list(key), any_null(key)
    told = new.filter(~keyless).select(*key, F.struct(*version).alias("_told"))
    met = old.join(told, key, "left").select(*old.columns, "_told")
    later = F.struct(*version) > F.col("_told")
    stays = met.filter(F.col("_told").isNull() | later).drop("_told")
    beaten = met.filter(later).select(*key)
    return stays.unionByName(new.filter(~keyless).join(beaten, key, "left_anti").select(*new.columns)).unionByName(new.filter(keyless))


def upsert(new: DataFrame, path: str, key: Sequence[str], version: Sequence[str], batch: str | None = None) -> set[int]:
    """Insert or overwrite by key; returns the buckets that were rewritten.

    The row with the larger ``version`` columns (null is least) stays; of equal ones, the new row.
    """
    spark = new.sparkSession
    known = versions(spark, path)
    if batch is not None and any(not manifest(spark, path, v).filter(F.col("batch") == batch).isEmpty() for v in known):
        return set()
    rows = manifest(spark, path, known[-1]).collect()
    buckets = rows[0]["buckets"]
    new = _latest(new, key, version, buckets)
    touched = {r["_bucket"] for r in new.select("_bucket").distinct().collect()}
    if not touched:
        return touched
    found = _folders(spark, path, rows, touched)
    if found:
        new = merged(spark.read.parquet(*found).withColumn("_bucket", _bucket(key, buckets)), new, key, version)
    folder = _written(new, path, known[-1] + 1)
    hit = lambda r: r["bucket"] in touched
    _publish(spark, path, known[-1] + 1, [(r["bucket"], folder if hit(r) else r["folder"], batch if hit(r) else r["batch"], buckets) for r in rows])
    return touched
