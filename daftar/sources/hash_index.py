"""The content hashes of a store, in buckets, with a mergeable Bloom filter kept beside them.

A batch is first tested against the filter's blocks (a join by block; about two bytes per
stored hash).  Only what hits goes on to the stored hashes, and only to those of its buckets; there the answer
is exact.  An append writes its hashes and its part of the filter in folders of their own and names
them in a new manifest, so readers see both or neither.  Parts of the filter are merged by
bitwise or; a filter filled beyond its size is laid anew, larger, from the hash column.

A retried append names its ``batch`` and is done once.  Null hashes equal nothing and are not kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators.dedup import keep_first_copy
from daftar.session import durable
from daftar.sources import keyed_store
from daftar.sources.keyed_store import versions

BUCKETS = 64
# A block has four words of 64 bits; a hash sets two bits in each.
WORDS = [f"_w{i}" for i in range(4)]
HASHES_PER_BLOCK = 16
# Parts of the filter that a probe reads at most.
PARTS = 8

_MANIFEST = "kind string, folder string, batch string, hashes long, buckets int, blocks int"


def manifest(spark: SparkSession, path: str) -> list:
    """The rows of the latest version, one per folder."""
    return spark.read.parquet(f"{path}/manifest/{versions(spark, path)[-1]}").collect()


def _publish(spark: SparkSession, path: str, version: int, rows: list[tuple]) -> None:
    draft = f"{path}/manifest/_{version}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(draft)
    source, files = keyed_store.at(spark, draft)
    target, _ = keyed_store.at(spark, f"{path}/manifest/{version}")
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)
        raise RuntimeError(f"version {version} of {path} was written meanwhile")


def _folder(path: str, kind: str, version: int) -> str:
    return f"{path}/{kind}/{version}-{uuid.uuid4().hex}"


def _bucketed(hashes: DataFrame, buckets: int) -> DataFrame:
    return hashes.withColumn("_bucket", F.pmod(F.xxhash64("content_hash"), F.lit(buckets)).cast("int"))


def _masked(hashes: DataFrame, blocks: int) -> DataFrame:
    """Adds ``_block`` and the bits of the hash in each word."""

    def bit(at: int) -> Column:
        return F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_bits, {at}) & 63 as int))")

    spread = hashes.withColumns({
        "_block": F.pmod(F.xxhash64("content_hash", F.lit("block")), F.lit(blocks)).cast("int"),
        "_bits": F.xxhash64("content_hash", F.lit("bits")),
    })
    words = {w: bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i, w in enumerate(WORDS)}
    return spread.withColumns(words).drop("_bits")


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("_bucket", "_block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def _write(rows: DataFrame, folder: str) -> None:
    rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)


def _read(spark: SparkSession, folders: list[str], schema: str, buckets: set[int] | None = None) -> DataFrame:
    """Rows of some folders; with ``buckets``, of those buckets' folders only."""
    found = spark.read.schema(f"{schema}, _bucket int")
    out = [found.parquet(f) for f in folders]
    if buckets is not None:
        out = [df.filter(F.col("_bucket").isin(sorted(buckets))) for df in out]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


_HASHES = "content_hash string"
_BLOCKS = "_block int, " + ", ".join(f"{w} long" for w in WORDS)


def _blocks_for(hashes: int, buckets: int) -> int:
    return max(1, -(-hashes // (buckets * HASHES_PER_BLOCK)))


def create(hashes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new index of the ``content_hash`` values of ``hashes``, with room for as many again."""
    _add(hashes, path, 0, [], buckets, None)


def append(hashes: DataFrame, path: str, batch: str | None = None) -> None:
    spark = hashes.sparkSession
    rows = manifest(spark, path)
    if batch is None or all(r["batch"] != batch for r in rows):
        _add(hashes, path, versions(spark, path)[-1] + 1, rows, rows[0]["buckets"], batch)


def _add(hashes: DataFrame, path: str, version: int, rows: list, buckets: int, batch: str | None) -> None:
    spark = hashes.sparkSession
    data = _folder(path, "hashes", version)
    _write(_bucketed(hashes.select("content_hash").dropna().distinct(), buckets), data)
    stored = [r for r in rows if r["kind"] == "hashes"]
    parts = [r for r in rows if r["kind"] == "blocks"]
    added = _read(spark, [data], _HASHES)
    count = added.count()
    total = count + sum(r["hashes"] for r in stored)
    kept = [tuple(r) for r in stored] + [("hashes", data, batch, count, buckets, 0)]
    blocks = parts[0]["blocks"] if parts else 0
    folder = _folder(path, "blocks", version)
    if _blocks_for(total, buckets) > blocks:
        blocks = 2 * _blocks_for(total, buckets)
        _write(_merged(_masked(_read(spark, [r[1] for r in kept], _HASHES), blocks)), folder)
        parts = []
    else:
        new = _merged(_masked(added, blocks))
        if len(parts) >= PARTS:
            new = _merged(_read(spark, [r["folder"] for r in parts], _BLOCKS).unionByName(new))
            parts = []
        _write(new, folder)
    _publish(spark, path, version, [*kept, *map(tuple, parts), ("blocks", folder, batch, total, buckets, blocks)])


def _bytes(spark: SparkSession, folders: list[str]) -> int:
    sizes = 0
    for folder in folders:
        where, files = keyed_store.at(spark, folder)
        sizes += files.getContentSummary(where).getLength() if files.exists(where) else 0
    return sizes


def unseen(new: DataFrame, path: str, key: str = "chunk_id", told: dict | None = None) -> DataFrame:
    """Rows of ``new`` whose ``content_hash`` is not stored, the lowest ``key`` of each; rows without a hash all stay.

    ``told`` receives what was read: hashes that hit the filter, those of them that are stored, buckets and bytes.
    """
    spark = new.sparkSession
    rows = manifest(spark, path)
    parts = [r for r in rows if r["kind"] == "blocks"]
    data = [r["folder"] for r in rows if r["kind"] == "hashes"]
    buckets, blocks = parts[0]["buckets"], parts[0]["blocks"]
    asked = _masked(_bucketed(new.select("content_hash").dropna().distinct(), buckets), blocks)
    # A hash's bits all lie in the part of the append that added it, so parts are asked as they are.
    filled = _read(spark, [r["folder"] for r in parts], _BLOCKS).alias("f")
    same = (F.col("a._bucket") == F.col("f._bucket")) & (F.col("a._block") == F.col("f._block"))
    for w in WORDS:
        same &= F.col(f"f.{w}").bitwiseAND(F.col(f"a.{w}")) == F.col(f"a.{w}")
    hits = durable(asked.alias("a").join(filled, same, "left_semi").select("content_hash", "_bucket"), "hits")
    touched = {r["_bucket"] for r in hits.select("_bucket").distinct().collect()}
    stored = _read(spark, data, _HASHES, touched)
    known = durable(hits.join(stored, ["_bucket", "content_hash"], "left_semi").select("content_hash"), "known")
    if told is not None:
        told.update(
            hits=hits.count(), stored=known.count(), buckets=len(touched),
            bytes_read=_bytes(spark, [f"{f}/_bucket={b}" for f in data for b in touched]) + _bytes(spark, [r["folder"] for r in parts]),
            bytes_stored=_bytes(spark, [r["folder"] for r in rows]),
        )
    return keep_first_copy(new, key).join(known, "content_hash", "left_anti").select(*new.columns)
