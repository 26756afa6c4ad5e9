"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.operators.skew import keep_first, lookup_per_key


def mark_duplicates_in_document(chunks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``is_duplicate``: hash stored for the document already, or seen earlier in it.

    ``chunks(document_id, chunk_index, content_hash, ...)``.  The first index per
    hash is pre-aggregated map-side and looked up, so many copies of one text do
    not meet in one task.
    """
    per_hash = chunks.groupBy("document_id", "content_hash").agg(
        F.min("chunk_index").alias("_first"), F.count("*").alias("_copies"), F.lit(False).alias("_stored")
    )
    if existing is not None:
        known = existing.select("document_id", "content_hash").distinct().withColumn("_known", F.lit(True))
        per_hash = (
            per_hash.join(known, ["document_id", "content_hash"], "left")
            .withColumn("_stored", F.col("_known").isNotNull())
            .drop("_known")
        )
    # Only groups that make something a duplicate have to be looked up.
    per_hash = per_hash.filter((F.col("_copies") > 1) | F.col("_stored"))
    out = lookup_per_key(chunks, per_hash, ["document_id", "content_hash"])
    dup = F.coalesce(F.col("_stored") | (F.col("chunk_index") > F.col("_first")), F.lit(False))
    return out.withColumn("is_duplicate", dup).select(*chunks.columns, "is_duplicate")


def dedup_global(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``is_duplicate`` and ``duplicate_of`` over the whole corpus; the lowest id survives."""
    copies = (
        chunks.filter(F.col("content_hash").isNotNull()).groupBy("content_hash")
        .agg(F.min(key).alias("_survivor"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
    )
    out = lookup_per_key(chunks, copies, ["content_hash"])
    dup = F.coalesce(F.col("_survivor") != F.col(key), F.lit(False))
    return out.withColumn("is_duplicate", dup).withColumn("duplicate_of", F.when(dup, F.col("_survivor"))).drop("_survivor", "_copies")


def keep_first_copy(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Only the surviving row of each hash; rows without a hash all stay."""
    hashed = F.col("content_hash").isNotNull()
    return keep_first(chunks.filter(hashed), ["content_hash"], [F.col(key)]).unionByName(chunks.filter(~hashed))


def dedup_against_store(new: DataFrame, store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows whose hash is not stored, one per hash."""
    return keep_first_copy(new, key).join(store.select("content_hash").distinct(), "content_hash", "left_anti")


def skipped_count(new: DataFrame, kept: DataFrame) -> DataFrame:
    a = new.agg(F.count("*").alias("total"))
    return a.withColumn("kept", kept.agg(F.count("*")).scalar()).withColumn("skipped", F.col("total") - F.col("kept"))


def hash_union(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.select("content_hash").union(new.select("content_hash")).distinct()
