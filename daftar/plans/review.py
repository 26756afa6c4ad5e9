"""The review path: pages to scored, repaired and embedded chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators import chunking, dedup, edit, health, models, quality
from daftar.operators.filters import eligible
from daftar.session import durable, release, tracked
from daftar.sources import pages as page_source


@dataclass
class Prepared:
    documents: DataFrame
    chunks: DataFrame
    versions: DataFrame
    logs: DataFrame
    paths: list[str] = field(default_factory=list)
    #: Counts by stage, observed while the stages were written.
    metrics: dict[str, dict[str, int]] = field(default_factory=dict)

    def close(self) -> None:
        """Delete the tables of the stages; call it when the results are stored."""
        release(self.chunks.sparkSession, self.paths)


def scored_chunks(pages: DataFrame, classification: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Drafts with duplicate marks and quality.

    The drafts are written once: both the hash counts and the marked rows read
    them, and the page fold does not run twice.
    """
    # The text is written once; ``original_content`` is the same text here.
    drafts = chunking.chunk_pages(pages, classification, keep=("grade_name", "subject_name")).drop("original_content")
    drafts = dedup.mark_duplicates_in_document(durable(drafts, "drafts"), existing)
    joined = drafts.withColumns({
        "original_content": F.col("content"),
        "has_grade": F.col("grade_name").isNotNull(),
        "has_subject": F.col("subject_name").isNotNull(),
        "has_topic": F.coalesce("document_title", F.lit("")) != "",
    })
    scored = quality.score_chunks(joined)
    return scored.withColumns({
        "chunk_id": F.md5(F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))),
        "is_active": F.col("repair_status") != "rejected",
    })


def prepare_corpus(
    docs: DataFrame,
    grades: DataFrame,
    subjects: DataFrame,
    embedder: Callable[[], models.ModelFn],
    dim: int,
    classifier: Callable[[], models.ModelFn] | None = None,
    repairer: Callable[[], models.ModelFn] | None = None,
    existing: DataFrame | None = None,
    separator: str = "\f",
    keep_newlines: bool = False,
) -> Prepared:
    """docs(document_id, filename, text) to chunks ready for retrieval.

    Pages, drafts and scored chunks are written once each, and the answers
    of each model stage are written before they are used, so a retried task
    never asks a model twice for different results.  ``keep_newlines`` keeps the
    paragraph breaks of pages, so that long pages can be cut at them.  The caller
    stores the results and then calls ``close``.
    """
    with tracked() as paths:
        prepared = _prepare(docs, grades, subjects, embedder, dim, classifier, repairer, existing, separator, keep_newlines)
    prepared.paths = list(paths)
    return prepared


def _durable_chunks(chunks: DataFrame, name: str, counts: dict[str, Column] | None = None, told: dict | None = None) -> DataFrame:
    """``durable`` chunks, whose original text (never null) is stored where it differs from the text only."""
    lean = chunks.withColumn("original_content", F.nullif("original_content", "content"))
    return durable(lean, name, counts, told).withColumn("original_content", F.coalesce("original_content", "content"))


def _status_counts() -> dict[str, Column]:
    found = {s: F.count_if(F.col("repair_status") == s) for s in ("clean", "needs_review", "embedded", "rejected")}
    return {"rows": F.count("*"), **found}


def _prepare(docs, grades, subjects, embedder, dim, classifier, repairer, existing, separator, keep_newlines) -> Prepared:
    told: dict[str, dict[str, int]] = {}
    seen = {"rows": F.count("*"), "low_text": F.count_if(F.col("low_text"))}
    pages = durable(page_source.page_scan(docs, separator=separator, keep_newlines=keep_newlines), "pages", seen, told)
    mode = page_source.extraction_mode(pages)
    pages = page_source.ocr_mark(pages)
    asked = docs.select("document_id", "filename", page_source.document_preview(F.col("text"), separator, keep_newlines).alias("preview"))
    classification = models.classify_documents(asked, classifier, grades, subjects).drop("filename", "preview")
    if classifier is not None:
        classification = durable(classification, "classification")
    documents = docs.select("document_id", "filename").join(mode, "document_id", "left").join(classification, "document_id", "left")

    scored = _durable_chunks(scored_chunks(pages, classification, existing), "scored", {**_status_counts(), "duplicates": F.count_if(F.col("is_duplicate"))}, told)
    versions = None
    if repairer is not None:
        seen = {"rows": F.count("*"), "failed": F.count("repair_error")}
        answers = durable(models.repair_chunks(scored, repairer), "repairs", seen, told)
        edits = answers.filter(F.col("repair_error").isNull()).select(
            "chunk_id", F.col("repaired_content").alias("content"), "title", "language", "repair_status",
            F.current_timestamp().alias("edited_at"),
        )
        base = scored.withColumns({"embedding_status": F.lit("pending"), "updated_at": F.current_timestamp()})
        edited = edit.apply_edits(base, edits)
        versions = scored.join(edited.filter("content_changed").select("chunk_id"), "chunk_id", "left_semi").select(
            "chunk_id", F.lit(1).alias("version_index"), "content", "content_hash"
        )
        notes = answers.select("chunk_id", "repair_notes", "quality_score_after", F.col("generated_content").alias("has_generated"), "repair_error")
        scored = _durable_chunks(edited.drop("content_changed", "embedding_status", "updated_at").join(notes, "chunk_id", "left"), "repaired")

    embedded = models.embed_chunks(scored.filter(eligible()), embedder, dim)
    rest = scored.filter(~eligible())
    seen = {**_status_counts(), "vectors": F.count("embedding"), "vectors_failed": F.count("embedding_error")}
    chunks = _durable_chunks(embedded.unionByName(rest, allowMissingColumns=True), "chunks", seen, told)
    if versions is None:
        versions = scored.limit(0).select("chunk_id", F.lit(1).alias("version_index"), "content", "content_hash")
    return Prepared(documents, chunks, versions, page_source.ocr_logs(pages).unionByName(_failures(chunks)), metrics=told)


def _failures(chunks: DataFrame) -> DataFrame:
    """A log line for each repair that was rejected or failed, and each vector that could not be made."""
    def has(name: str) -> bool:
        return name in chunks.columns

    at = F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string"), F.lit(": "))
    lines = []
    if has("repair_error"):
        rejected = (F.col("repair_status") == "rejected") & F.col("quality_score_after").isNotNull()
        score = F.col("quality_score_after").cast("string")
        lines.append(F.when(rejected, F.struct(F.lit("warn").alias("level"), F.concat(at, F.lit("repair rejected, score "), score, F.lit(".")).alias("message"))))
        failed = F.col("repair_error").isNotNull()
        lines.append(F.when(failed, F.struct(F.lit("error").alias("level"), F.concat(at, F.lit("repair failed: "), F.col("repair_error")).alias("message"))))
    failed = F.col("embedding_error").isNotNull()
    lines.append(F.when(failed, F.struct(F.lit("error").alias("level"), F.concat(at, F.lit("embedding failed: "), F.col("embedding_error")).alias("message"))))
    rows = chunks.select("document_id", F.col("page_start").cast("int").alias("page_number"), F.posexplode(F.array(*lines)).alias("line", "_log"))
    return rows.filter(F.col("_log").isNotNull()).select("document_id", "page_number", "line", "_log.level", "_log.message")


def stage_counts(prepared: Prepared) -> DataFrame:
    """Rows per final status."""
    return health.status_counts(prepared.chunks, "repair_status")


def metrics_table(spark: SparkSession, prepared: Prepared) -> DataFrame:
    """(stage, counter, value): what the run counted while it wrote its stages."""
    rows = [(stage, counter, int(value)) for stage, found in prepared.metrics.items() for counter, value in found.items()]
    return spark.createDataFrame(rows, "stage string, counter string, value long")
