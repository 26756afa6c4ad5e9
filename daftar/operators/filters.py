"""Predicates and filtered listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar import schema
from daftar.functions.text import MIN_CONTENT, js_trim, wash_text

MIN_EMBED_CHARS = 100


def filter_chunks(
    df: DataFrame,
    document_id=None,
    grade_id=None,
    subject_id=None,
    status: str | None = None,
    min_quality: float | None = None,
    ocr: bool | None = None,
    duplicate: bool | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Chunks meeting every given condition; the ``limit`` newest, if one is given."""
    equal = {
        "document_id": document_id, "grade_id": grade_id, "subject_id": subject_id,
        "repair_status": status, "ocr_detected": ocr, "is_duplicate": duplicate,
    }
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    if min_quality is not None:
        df = df.filter(F.col("quality_score") >= min_quality)
    if limit is None:
        return df
    return df.orderBy(F.col("updated_at").desc(), F.col("chunk_id")).limit(limit)


def min_content_gate(df: DataFrame, text: str = "text", n: int = MIN_CONTENT) -> DataFrame:
    return df.filter(F.length(wash_text(F.col(text))) >= n)


def awaiting_embedding() -> Column:
    status = F.col("embedding_status")
    return F.col("embedding").isNull() & (status.isNull() | status.isin("pending", "failed"))


def embed_viability(df: DataFrame, n: int = MIN_EMBED_CHARS, short_status: str = "skipped") -> DataFrame:
    """Rows awaiting a vector, marked ``claimable`` or, when too short, skipped."""
    length = F.coalesce(F.length(js_trim(F.col("content"))), F.lit(0))
    return df.filter(awaiting_embedding()).withColumn(
        "embedding_status", F.when(length < n, short_status).otherwise("claimable")
    )


def eligible() -> Column:
    """Active, in a status that may be embedded, and hashed; never null."""
    fits = F.col("is_active") & F.col("repair_status").isin(*schema.EMBEDDABLE_STATUS) & F.col("content_hash").isNotNull()
    return F.coalesce(fits, F.lit(False))


def embed_eligible(df: DataFrame) -> DataFrame:
    return df.filter(eligible())


def choice_key(c: Column) -> Column:
    return js_trim(F.lower(c))


def allowed_choice(df: DataFrame, value: str, choices: DataFrame, name: str) -> DataFrame:
    """Rows whose ``value`` is among the choices, ignoring case and outer blanks.

    An empty choice list allows every value; null and empty never pass.
    """
    keys = choices.select(choice_key(F.col(name)).alias("_choice")).distinct()
    listed = df.join(keys, choice_key(F.col(value)) == F.col("_choice"), "left_semi")
    anything = df.filter((F.col(value) != "") & ~choices.exists())
    return listed.filter(F.col(value) != "").unionByName(anything)


def candidate_filter(df: DataFrame, status: str = "all", grade: str = "all") -> DataFrame:
    if status != "all":
        df = df.filter(F.col("status") == status)
    if grade != "all":
        df = df.filter(F.col("detected_grade") == grade)
    return df


def distinct_grades(df: DataFrame) -> DataFrame:
    return df.select("detected_grade").filter(F.col("detected_grade").isNotNull()).distinct()


def vector_gap(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks without a vector; a listing passes its page size."""
    gap = df.filter(F.col("embedding").isNull())
    return gap if limit is None else gap.orderBy("chunk_id").limit(limit)


def enum_check(df: DataFrame, key: str, enums: Mapping[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """One row per broken rule: a value outside its closed set, or a missing one."""
    rules = [
        F.when(~F.col(c).isin(*values), F.lit(f"{c}_not_allowed")) for c, values in enums.items()
    ] + [F.when(F.col(c).isNull(), F.lit(f"{c}_missing")) for c in required]
    return df.select(key, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def project(df: DataFrame, columns: Sequence[str | Column], order: Sequence[Column], limit: int) -> DataFrame:
    """Selected columns of the first rows, for an explorer page."""
    return df.orderBy(*order).limit(limit).select(*columns)
