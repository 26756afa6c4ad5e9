"""File listings, upload checks and document registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 60 * 1024 * 1024


def file_status(name: Column) -> Column:
    return (
        F.when(name.endswith(".done.pdf"), "done")
        .when(name.endswith(".error.pdf"), "error")
        .otherwise("pending")
    )


def listing(files: DataFrame) -> DataFrame:
    """Name, size and state of ``binaryFile`` rows; the bytes are never read."""
    name = F.substring_index("path", "/", -1)
    return files.select(
        "path",
        F.try_url_decode(name).alias("filename"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"),
        file_status(name).alias("status"),
    )


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing of the PDF files under ``root``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.pdf")
        .load(root)
    )
    return listing(files)


def inventory_counts(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )


def file_validate(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds ``accepted`` and ``reject_reason``; needs mime_type and file_size."""
    wrong_type = F.coalesce(F.col("mime_type"), F.lit("")) != "application/pdf"
    reason = F.when(wrong_type, "type").when(F.col("file_size") > max_bytes, "size")
    return files.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def _first_of(*keys: str) -> Column:
    return F.coalesce(*[F.try_element_at("metadata", F.lit(k)) for k in keys])


def register_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document rows and one pending job each.

    Ids derive from the file path, so registering twice gives the same rows.
    Expects file_path, filename, file_size, mime_type, metadata, created_at.
    """
    documents = files.select(
        F.md5("file_path").alias("document_id"),
        "filename",
        F.col("filename").alias("original_filename"),
        "file_path",
        "mime_type",
        F.col("file_size").cast("long").alias("file_size"),
        _first_of("topic", "topicTitle").alias("title"),
        _first_of("grade", "gradeLabel").alias("detected_grade_name"),
        _first_of("subject", "subjectLabel").alias("detected_subject_name"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
    jobs = documents.select(
        F.md5(F.concat(F.lit("job:"), F.col("document_id"))).alias("job_id"),
        "document_id",
        F.lit("pending").alias("status"),
        F.lit(0).alias("retry_count"),
        "created_at",
        "updated_at",
    )
    return documents, jobs
