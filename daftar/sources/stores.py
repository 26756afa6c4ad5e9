"""Keyed writes against a stored table: insert-if-absent, upsert, two-way sync."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.operators.skew import any_null, keep_first


def insert_if_absent(new: DataFrame, store: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``new`` to append: first per key, keys already stored left out.

    As in a unique index, a null in the key equals nothing: such rows all stay.
    """
    keyless = any_null(key)
    fresh = keep_first(new.filter(~keyless), key, order).join(store.select(*key).distinct(), list(key), "left_anti")
    return fresh.select(*new.columns).unionByName(new.filter(keyless))


def upsert(new: DataFrame, store: DataFrame, key: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The table after inserting or overwriting by key.

    ``version`` orders the rows of one key, latest first; on equal versions the
    new row wins over the stored one.  Rows with a null in the key equal nothing
    and all stay.
    """
    both = new.withColumn("_new", F.lit(1)).unionByName(store.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    keyless = any_null(key)
    keyed = keep_first(both.filter(~keyless), key, [*version, F.col("_new").desc()])
    return keyed.unionByName(both.filter(keyless)).drop("_new")


def sync_delta(local: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Push embedded rows to the remote table, pull its unknown pending rows.

    local(chunk_id, content, embedding, status), remote(chunk_id, content,
    embedding, embedding_status).  Returns both tables after the exchange.
    """
    push = local.filter(F.col("status") == "embedded").select(
        "chunk_id", F.col("embedding").alias("_vector"), F.lit(True).alias("_pushed")
    )
    remote_after = (
        remote.join(push, "chunk_id", "left")
        .withColumn("embedding", F.coalesce("_vector", "embedding"))
        .withColumn("embedding_status", F.when(F.col("_pushed"), "done").otherwise(F.col("embedding_status")))
        .select(*remote.columns)
    )
    pulled = (
        remote.filter(F.col("embedding_status") == "pending")
        .join(local.select("chunk_id"), "chunk_id", "left_anti")
        .select("chunk_id", "content", F.lit(None).cast(local.schema["embedding"].dataType).alias("embedding"),
                F.lit("pending").alias("status"))
    )
    kept = local.withColumn("status", F.when(F.col("status") == "embedded", "uploaded").otherwise(F.col("status")))
    return remote_after, kept.unionByName(pulled)
