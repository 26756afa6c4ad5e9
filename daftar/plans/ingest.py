"""The folder-ingest path: files to classified, de-duplicated window chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import wash_text
from daftar.operators import aliases, chunking, dedup, health, models, resolve
from daftar.operators.filters import min_content_gate
from daftar.session import durable
from daftar.sources import hash_index


@dataclass
class Dimensions:
    grades: DataFrame
    cycles: DataFrame
    subjects: DataFrame
    topics: DataFrame
    alias_index: DataFrame


def classified_files(files: DataFrame, dims: Dimensions) -> DataFrame:
    """Hints and ids per file: grade, cycle, curriculum, topic and subject.

    Everything is resolved once per file, before the texts become chunks.
    """
    names = files.select("file_id", "filename")
    hints = aliases.filename_hints(names, dims.alias_index)
    hints = aliases.canonical_grade(hints, dims.alias_index)
    out = resolve.resolve_ancestors(hints, dims.grades, dims.cycles)
    out = resolve.resolve_topic(out, dims.topics)
    return resolve.resolve_fallback(out, dims.subjects, dims.topics).withColumnRenamed("topic_id", "source_id")


def file_chunks(files: DataFrame) -> DataFrame:
    """Window chunks of files(file_id, filename, text) with enough text."""
    washed = files.withColumn("text", wash_text(F.col("text")))
    cut = chunking.chunk_window(min_content_gate(washed))
    return cut.withColumns({
        "content_hash": F.md5("content"),
        "chunk_size": F.length("content"),
        "chunk_id": F.md5(F.concat_ws(":", F.col("file_id").cast("string"), F.col("chunk_index").cast("string"))),
    })


def ingest_corpus(
    files: DataFrame,
    store: DataFrame,
    dims: Dimensions,
    embedder: Callable[[], models.ModelFn],
    dim: int,
    formatter: Callable[[], models.ModelFn] | None = None,
    hashes: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows to append to the chunk store, and the counters per file.

    store(content_hash, metadata map) is the chunk table so far.  With ``hashes``, the path of
    its ``hash_index``, new chunks are held against that instead of the whole table; once the
    rows are stored, the caller appends their hashes there (``hash_index.append``).
    """
    new = resolve.already_ingested(files, store, present=False)
    classes = classified_files(new, dims)
    if formatter is not None:
        subject = classes.select("file_id", "subject_hint")
        ready = new.join(subject, "file_id").withColumn("text", wash_text(F.col("text")))
        new = durable(models.format_documents(ready, formatter, key="file_id").drop("subject_hint"), "formatted")
    cut = durable(file_chunks(new), "cut")  # texts are cut once, for the rows and for the counters
    fresh = hash_index.unseen(cut, hashes) if hashes else dedup.dedup_against_store(cut, store)
    embedded = models.embed_text(fresh, embedder, F.col("content"), dim)
    rows = embedded.join(classes.drop("filename"), "file_id", "left")
    ok = F.col("embedding").isNotNull()
    rows = rows.withColumns({
        "embedding_status": F.when(ok, "done").otherwise("pending"),
        "is_processed": ok,
        "source_type": F.lit("lesson_block"),
        "metadata": F.create_map(F.lit("filename"), F.col("filename"), F.lit("grade"), F.col("grade_hint"), F.lit("subject"), F.col("subject_hint")),
    })
    rows = durable(rows, "ingested")
    done = rows.select("chunk_id", F.lit("inserted").alias("outcome"), "embedding")
    outcome = cut.select("chunk_id", "filename").join(done, "chunk_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))
    short = new.select("filename").join(cut.select("filename").distinct(), "filename", "left_anti").withColumn("outcome", F.lit("skipped_short"))
    outcome = outcome.unionByName(short, allowMissingColumns=True)
    return rows, health.ingest_counters(outcome, "filename")
