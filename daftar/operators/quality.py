"""Rule-based quality of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import (
    LETTERS_IN, broken_spacing, js_trim, letter_count, poor_title, repeated_noise,
)

# Penalty of each flag in hundredths, in the order flags are listed.
PENALTIES = {
    "too_short": 25,
    "too_long": 20,
    "low_alpha_density": 30,
    "ocr_noise": 20,
    "broken_spacing": 15,
    "missing_title": 10,
    "poor_title_quality": 10,
    "missing_grade": 10,
    "missing_subject": 10,
    "missing_topic": 10,
    "ocr_detected": 8,
    "low_educational_value": 20,
    "duplicate": 40,
}
SHORT, LONG, DENSITY, MIN_SCORE = 120, 2500, 0.3, 45


def flag_conditions(script_aware: bool = False) -> dict[str, Column]:
    content, title = F.col("content"), F.col("title")
    trimmed = js_trim(content)
    n = F.length(trimmed)
    no_title = F.coalesce(title, F.lit("")) == ""
    short_title = (F.length(js_trim(title)) < 3) | poor_title(js_trim(title), script_aware)
    return {
        "too_short": n < SHORT,
        "too_long": n > LONG,
        "low_alpha_density": letter_count(content) / n < DENSITY,
        "ocr_noise": repeated_noise(content),
        "broken_spacing": broken_spacing(content),
        "missing_title": no_title,
        "poor_title_quality": ~no_title & short_title,
        "missing_grade": ~F.col("has_grade"),
        "missing_subject": ~F.col("has_subject"),
        "missing_topic": ~F.col("has_topic"),
        "ocr_detected": F.col("ocr_detected"),
        "low_educational_value": ~trimmed.rlike(f"[{LETTERS_IN}0-9]"),
    }


def content_flags(chunks: DataFrame, script_aware: bool = False) -> DataFrame:
    """Adds ``flags``: all but the duplicate and threshold flags.

    Needs the text but no other row, so it runs in the scan stage; the text can be
    dropped before the rows are compared with each other.
    """
    empty = F.length(js_trim(F.col("content"))) == 0
    conditions = flag_conditions(script_aware)
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()]))
    return chunks.withColumn("flags", F.when(empty, F.array(F.lit("empty_content"))).otherwise(found))


def finish_score(flagged: DataFrame) -> DataFrame:
    """Score, status and final flags from ``flags`` and ``is_duplicate``."""
    empty = F.array_contains("flags", "empty_content")
    marked = F.concat("flags", F.array(F.lit("duplicate")))
    df = flagged.withColumn("_found", F.when(~empty & F.col("is_duplicate"), marked).otherwise(F.col("flags")))
    weights = F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])
    lost = F.aggregate("_found", F.lit(0), lambda s, f: s + F.coalesce(F.try_element_at(weights, f), F.lit(0)))
    df = df.withColumn("_points", F.when(empty, F.lit(0)).otherwise(F.greatest(F.lit(0), F.lit(100) - lost)))
    below = ~empty & ~F.col("is_duplicate") & (F.col("_points") < MIN_SCORE)
    df = df.withColumn("is_rejected", empty | below)
    flags = F.when(below, F.concat("_found", F.array(F.lit("below_quality_threshold")))).otherwise(F.col("_found"))
    status = (
        F.when(F.col("is_rejected"), "rejected")
        .when(F.col("is_duplicate"), "duplicate")
        .when(F.size("_found") > 0, "needs_review")
        .otherwise("clean")
    )
    return df.withColumns({
        "flags": flags,
        "quality_score": F.col("_points") / F.lit(100.0),
        "repair_status": status,
    }).drop("_found", "_points")


def score_chunks(chunks: DataFrame, script_aware: bool = False) -> DataFrame:
    """Adds flags, quality_score, repair_status and is_rejected.

    Expects content, title, ocr_detected, is_duplicate, has_grade, has_subject,
    has_topic.  Scores are summed in whole hundredths.
    """
    return finish_score(content_flags(chunks, script_aware))
