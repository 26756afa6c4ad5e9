"""The corpus clean-up as one plan, with a before/after report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.operators import edit, health


def cleanup_corpus(chunks: DataFrame, json: bool = False) -> DataFrame:
    """Drop broken rows, fill hashes, requeue stuck embeddings, seed the status,
    drop rows without grade and subject.  Filters and projections only, so it is
    one pass over the table."""
    df = edit.conditional_delete(chunks, edit.broken_content())
    df = df.withColumn("content_hash", F.coalesce("content_hash", F.md5("content")))
    stuck = F.col("embedding").isNull() & F.col("embedding_status").isin("failed", "processing")
    df = edit.conditional_update(df, stuck, {"embedding_status": F.lit("pending"), "embedding_claimed_at": F.lit(None)})
    seed = F.when(F.col("embedding").isNotNull(), "done").otherwise("pending")
    df = edit.conditional_update(df, F.col("embedding_status").isNull(), {"embedding_status": seed})
    return edit.conditional_delete(df, edit.unclassified(both=True, json=json))


def cleanup_report(before: DataFrame, after: DataFrame) -> DataFrame:
    a = health.status_missing_report(before).withColumn("phase", F.lit("before"))
    return a.unionByName(health.status_missing_report(after).withColumn("phase", F.lit("after")))
