"""Status counts and corpus health, each in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.data import metadata_null
from daftar.operators.filters import awaiting_embedding
from daftar.operators.skew import keep_first




def status_counts(df: DataFrame, status: str = "embedding_status") -> DataFrame:
    return df.groupBy(F.coalesce(status, F.lit("null")).alias(status)).agg(
        F.count("*").alias("total"), F.count("embedding").alias("with_embedding")
    )


def null_diagnosis(df: DataFrame, json: bool = False) -> DataFrame:
    def nulls(c: str) -> Column:
        return F.count_if(F.col(c).isNull())

    return df.agg(
        F.count("*").alias("total_rows"),
        nulls("content").alias("null_content"),
        nulls("content_hash").alias("null_hash"),
        nulls("embedding").alias("null_embedding"),
        nulls("source_id").alias("null_source_id"),
        nulls("embedding_status").alias("null_status"),
        F.count_if(F.col("embedding_status") == "failed").alias("failed_status"),
        F.count_if(metadata_null(F.col("metadata"), "grade", json)).alias("null_grade"),
        F.count_if(metadata_null(F.col("metadata"), "subject", json)).alias("null_subject"),
    )


def health_check(df: DataFrame) -> DataFrame:
    status = F.col("embedding_status")
    return df.agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.col("content") != "").alias("with_content"),
        F.count("embedding").alias("with_embedding"),
        F.count_if(status == "done").alias("status_done"),
        F.count_if(status == "pending").alias("status_pending"),
        F.count_if(status == "failed").alias("status_failed"),
        F.count_if(F.col("document_id").isNull()).alias("missing_document_id"),
    )


def unclassified_by_file(df: DataFrame, json: bool = False) -> DataFrame:
    meta = F.col("metadata")
    name = F.get_json_object(meta, "$.filename") if json else F.try_element_at(meta, F.lit("filename"))
    hit = metadata_null(meta, "grade", json) & metadata_null(meta, "subject", json)
    return df.filter(hit).groupBy(name.alias("filename")).agg(F.count("*").alias("rows_to_drop"))


def status_missing_report(df: DataFrame) -> DataFrame:
    return df.groupBy("embedding_status").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("embedding").isNull()).alias("missing_vector"),
        F.count_if(F.col("source_id").isNull()).alias("missing_source_id"),
    )


def quality_scan_rollup(scored: DataFrame, *keys: str) -> DataFrame:
    status = F.col("repair_status")
    return scored.groupBy(*keys).agg(
        F.count("*").alias("chunks"),
        F.count_if(status == "clean").alias("clean"),
        F.count_if(status == "needs_review").alias("needs_review"),
        F.count_if(F.col("is_duplicate")).alias("duplicate"),
        F.count_if(F.col("is_rejected")).alias("rejected"),
    )


def ingest_counters(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Inserted, embedded and skipped rows per file from ``outcome`` and ``embedding``.

    ``skipped_short`` counts files that were too short to give a chunk.
    """
    inserted = F.col("outcome") == "inserted"
    return outcomes.groupBy(*keys).agg(
        F.count_if(inserted).alias("inserted"),
        F.count_if(inserted & F.col("embedding").isNotNull()).alias("embedded"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "skipped_short").alias("skipped_short"),
    )


def file_progress(files: DataFrame) -> DataFrame:
    status = F.col("status")
    out = files.agg(
        F.count("*").alias("total"),
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "error").alias("error"),
        F.count_if(status == "pending").alias("pending"),
    )
    share = F.when(F.col("total") > 0, F.round(100 * (F.col("done") + F.col("error")) / F.col("total"), 0)).otherwise(F.lit(0.0))
    return out.withColumn("percent", share.cast("int"))


def queue_size(files: DataFrame) -> DataFrame:
    return files.agg(F.sum("file_size").alias("total_bytes"), F.count("*").alias("files"))


def retrieval_pass_rate(tests: DataFrame, *keys: str) -> DataFrame:
    """Tests with ``passed``, the ``rank`` of the own chunk (null if absent) and ``top_score``."""
    return tests.groupBy(*keys).agg(
        F.count("*").alias("tests"),
        F.count_if(F.col("passed")).alias("passed"),
        F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"),
        F.round(F.avg("rank"), 4).alias("mean_rank"),
        F.round(F.avg("top_score"), 4).alias("mean_top_score"),
    )


def progress_eta(df: DataFrame, started_at: Column, now: Column) -> DataFrame:
    """Done and pending counts, percent, milliseconds per row and remaining milliseconds."""
    out = df.agg(
        F.count_if(F.col("embedding_status") == "done").alias("done"),
        F.count_if(awaiting_embedding()).alias("pending"),
    )
    total = F.col("done") + F.col("pending")
    elapsed = F.unix_millis(now.cast("timestamp")) - F.unix_millis(started_at.cast("timestamp"))
    out = out.withColumn("percent", F.when(total > 0, F.round(100 * F.col("done") / total, 0)).otherwise(F.lit(0.0)).cast("int"))
    out = out.withColumn("ms_per_row", F.when(F.col("done") > 0, F.round(elapsed / F.col("done"), 3)))
    return out.withColumn("eta_ms", F.round(elapsed / F.nullif(F.col("done"), F.lit(0)) * F.col("pending"), 0))


def stale_claims(df: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Claims older than the timeout go back to pending."""
    cutoff = now - F.make_interval(mins=F.lit(minutes))
    stale = (F.col("embedding_status") == "processing") & (F.col("embedding_claimed_at") < cutoff)
    return df.withColumn("embedding_status", F.when(stale, "pending").otherwise(F.col("embedding_status")))


def ingest_active(df: DataFrame, now: Column, minutes: int = 2) -> DataFrame:
    status = F.col("embedding_status")
    recent = (status.isNull() | (status == "pending")) & (F.col("created_at") >= now - F.make_interval(mins=F.lit(minutes)))
    return df.agg(
        F.count_if(status == "processing").alias("processing"), F.count_if(recent).alias("recent")
    ).withColumn("active", (F.col("processing") > 0) | (F.col("recent") > 0))


def active_embedding(embeddings: DataFrame) -> DataFrame:
    """``is_active`` is true for the latest vector of each chunk only."""
    from daftar.operators.skew import lookup_per_key

    latest = embeddings.groupBy("chunk_id").agg(
        F.max(F.struct("created_at", "embedding_id")).alias("_latest"), F.count("*").alias("_n")
    )
    out = lookup_per_key(embeddings, latest, ["chunk_id"])
    mine = F.struct("created_at", "embedding_id") == F.col("_latest")
    return out.withColumn("is_active", mine).select(*[c for c in embeddings.columns if c != "is_active"], "is_active")


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return keep_first(df, [key], order)


def backfill_classification(pages: DataFrame) -> DataFrame:
    """Give every page its document's first valid classification, in page order.

    ``pages(document_id, page_number, grade, subject, is_valid, ...)``; documents
    without a valid page are dropped.
    """
    from daftar.operators.skew import lookup_per_key

    first = pages.groupBy("document_id").agg(
        F.min(F.when(F.col("is_valid"), F.struct("page_number", "grade", "subject"))).alias("_c"), F.count("*").alias("_n")
    )
    keyed = pages.withColumn("_row", F.xxhash64("document_id", "page_number"))
    out = lookup_per_key(keyed, first, ["document_id"]).filter(F.col("_c").isNotNull())
    return out.withColumn("grade", F.col("_c.grade")).withColumn("subject", F.col("_c.subject")).select(*pages.columns)


def dimension_check(embeddings: DataFrame, dim: int, truncate: bool = False) -> DataFrame:
    """``dim_ok``, and the vector cut to ``dim`` when ``truncate``."""
    v = F.slice("embedding", 1, dim) if truncate else F.col("embedding")
    return embeddings.withColumn("embedding", v).withColumn("dim_ok", F.coalesce(F.size(v) == dim, F.lit(False)))


def priority_batch(work: DataFrame, ranks: DataFrame, n: int, key: str = "chunk_id") -> DataFrame:
    """The next ``n`` rows of the first grade in order that has work.

    ``ranks(grade_id, rank)``.  Rows of unranked or missing grades come up only
    when no ranked grade has any.
    """
    ranked = work.join(ranks, "grade_id", "left")
    best = ranked.agg(F.min("rank")).scalar()
    return ranked.filter(F.col("rank").eqNullSafe(best)).orderBy(key).limit(n).select(*work.columns, "rank")


def table_inventory(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row count per table; a table that does not exist is given as None."""
    parts = []
    spark = next(t for t in tables.values() if t is not None).sparkSession
    for name, table in tables.items():
        if table is None:
            part = spark.range(1).select(F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("row_count"), F.lit(True).alias("missing"))
        else:
            part = table.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(False).alias("missing"))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn(
        "state", F.when(F.col("missing"), "missing").when(F.col("row_count") > 0, "populated").otherwise("empty")
    )


def inventory_todo(inventory: DataFrame, chunks: DataFrame, sections: DataFrame, tracks: DataFrame) -> DataFrame:
    """What to do next, with severity: seed sections and tracks, ingest, embed, fill sections."""
    counts = inventory.groupBy().pivot("table_name", ["bac_sections", "bac_tracks", "chunks"]).agg(F.first("row_count"))
    gap = chunks.agg(F.count_if(F.col("embedding").isNull())).scalar()
    rows = F.array_compact(F.array(
        F.when(F.coalesce("bac_sections", F.lit(0)) == 0, F.struct(F.lit("t1").alias("id"), F.lit("Initialize Bac Sections").alias("task"), F.lit("high").alias("severity"))),
        F.when((F.col("bac_sections") > 0) & (F.coalesce("bac_tracks", F.lit(0)) == 0), F.struct(F.lit("t2").alias("id"), F.lit("Add Tracks to existing Sections").alias("task"), F.lit("high").alias("severity"))),
        F.when(F.coalesce("chunks", F.lit(0)) == 0, F.struct(F.lit("t3").alias("id"), F.lit("Populate Content from PDFs").alias("task"), F.lit("medium").alias("severity"))),
        F.when((F.col("chunks") > 0) & (gap > 0), F.struct(F.lit("t_vector_gap").alias("id"), F.lit("Embed Existing Chunks").alias("task"), F.lit("high").alias("severity"))),
    ))
    todo = counts.select(F.explode(rows).alias("r")).select("r.*")
    empty = sections.join(tracks.select("section_id").distinct(), "section_id", "left_anti").select(
        F.concat(F.lit("s-"), "name").alias("id"), F.concat(F.lit("Add Tracks for "), "name").alias("task"), F.lit("medium").alias("severity")
    )
    return todo.unionByName(empty)
