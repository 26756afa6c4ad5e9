"""Conditional updates and deletes, backfills, reviewer edits, versions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.data import merge_metadata, metadata_null
from daftar.functions.text import content_hash, js_trim, normalize_content
from daftar.operators.skew import previous_value, running_index

SHORT_CONTENT = 50


def conditional_update(df: DataFrame, predicate: Column, changes: Mapping[str, Column]) -> DataFrame:
    """``UPDATE ... SET ... WHERE``; a null predicate changes nothing."""
    hit = F.coalesce(predicate, F.lit(False))
    new = {
        name: F.when(hit, value).otherwise(F.col(name)).cast(df.schema[name].dataType)
        for name, value in changes.items()
    }
    return df.withColumns(new)


def conditional_delete(df: DataFrame, predicate: Column) -> DataFrame:
    """``DELETE ... WHERE``; a null predicate deletes nothing."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def broken_content() -> Column:
    return F.col("content").isNull() | (F.length(js_trim(F.col("content"))) < SHORT_CONTENT)


def unclassified(both: bool = False, column: str = "metadata", json: bool = False) -> Column:
    """Grade or subject missing; with ``both`` only rows that lack the two."""
    grade = metadata_null(F.col(column), "grade", json)
    subject = metadata_null(F.col(column), "subject", json)
    return (grade & subject) if both else (grade | subject)


def backfill(df: DataFrame) -> DataFrame:
    """Fill what older rows lack: hash, original text, index, status, update time."""
    seeded = F.when(F.col("embedding").isNotNull(), "done").otherwise("pending")
    return df.withColumns({
        "content_hash": F.coalesce("content_hash", F.md5("content")),
        "original_content": F.coalesce("original_content", "content"),
        "updated_at": F.coalesce("updated_at", "created_at"),
        "chunk_index": F.coalesce("chunk_index", F.lit(0)),
        "embedding_status": F.when(
            F.col("embedding_status").isNull() | (F.col("embedding_status") == "pending"), seeded
        ).otherwise(F.col("embedding_status")),
    })


def reset_embeddings(df: DataFrame) -> DataFrame:
    """Drop all vectors, for instance before a change of dimension."""
    return df.withColumns({
        "embedding": F.lit(None).cast(df.schema["embedding"].dataType),
        "embedding_status": F.lit("pending"),
        "embedding_claimed_at": F.lit(None).cast("timestamp"),
    })


def chunk_versions(edits: DataFrame, current: DataFrame, width: int = 86_400) -> DataFrame:
    """Version rows for a log of edits.

    ``current(chunk_id, content, version_index)`` is the stored text and its
    highest version (0 if none); ``edits(chunk_id, edit_id, edited_at, content)``
    are applied in time order.  Each edit that changes the normalised text
    snapshots the text before it under the next version number.
    """
    at = F.unix_micros(F.col("edited_at").cast("timestamp")) / 1_000_000
    stored = current.select("chunk_id", F.col("content").alias("_stored"), F.col("version_index").alias("_base"))
    order = [F.col("edited_at"), F.col("edit_id")]
    log = edits.withColumn("_text", normalize_content(F.col("content")))
    log = previous_value(log, ["chunk_id"], at, order, "_text", "_before", width)
    log = log.join(stored, "chunk_id")
    before = F.coalesce("_before", "_stored")
    changed = log.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col("_text")))
    numbered = running_index(changed, ["chunk_id"], at, order, "_n", width)
    return numbered.select(
        "chunk_id",
        (F.col("_base") + F.col("_n") + 1).cast("int").alias("version_index"),
        F.col("_before").alias("content"),
        content_hash(F.col("_before")).alias("content_hash"),
        F.col("edited_at").alias("created_at"),
    )


def apply_edits(chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """Chunks after at most one edit each.

    Null fields of an edit keep the stored value, ids included.  New text means a
    new hash and a vector to be made again; a rejection takes the chunk out of use.
    ``content_changed`` tells which rows need a version and inactive vectors.
    """
    fields = ["title", "language", "page_start", "page_end", "grade_id", "subject_id", "topic_id", "repair_status"]
    given = [f for f in fields if f in edits.columns]
    renamed = edits.select(
        "chunk_id",
        F.col("content").alias("_content"),
        *[F.col(f).alias(f"_{f}") for f in given],
        *([F.col("metadata").alias("_metadata")] if "metadata" in edits.columns else []),
        F.col("edited_at").alias("_edited_at"),
    )
    joined = chunks.join(renamed, "chunk_id", "left")
    text = F.coalesce(normalize_content(F.col("_content")), F.col("content"))
    changed = F.col("_content").isNotNull() & ~text.eqNullSafe(F.col("content"))
    joined = joined.withColumn("content_changed", changed).withColumn("_text", text)
    new = {f: F.coalesce(f"_{f}", f) for f in given}
    new["content_hash"] = F.when(F.col("content_changed"), content_hash(F.col("_text"))).otherwise(F.col("content_hash"))
    new["content"] = F.col("_text")
    new["embedding_status"] = F.when(F.col("content_changed"), "pending").otherwise(F.col("embedding_status"))
    new["updated_at"] = F.coalesce("_edited_at", "updated_at")
    if "metadata" in edits.columns:
        new["metadata"] = merge_metadata(F.col("metadata"), F.col("_metadata"))
    if "repair_status" in given:
        new["is_active"] = F.col("is_active") & ~F.coalesce(F.col("_repair_status") == "rejected", F.lit(False))
    return joined.withColumns(new).select(*chunks.columns, "content_changed")


def deactivate_embeddings(embeddings: DataFrame, changed: DataFrame) -> DataFrame:
    """Vectors of chunks whose text changed are no longer active."""
    ids = changed.select("chunk_id").distinct().withColumn("_stale", F.lit(True))
    return (
        embeddings.join(ids, "chunk_id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_stale").isNull())
        .drop("_stale")
    )
