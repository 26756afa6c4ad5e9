"""Page text, its extraction mode, and the low-text marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.functions.text import LOW_TEXT, collapse_spaces, normalize_content
from daftar.operators.skew import keep_first

# Characters that a preview shows.
PREVIEW = 5000


def page_scan(docs: DataFrame, key: str = "document_id", text: str = "text", separator: str = "\f", keep_newlines: bool = False) -> DataFrame:
    """One row per page of a document text, cut at ``separator``.

    ``keep_newlines`` keeps paragraph breaks, which gives the page chunker
    boundaries to cut at; the plain form collapses all whitespace.
    """
    cut = docs.select(key, F.posexplode(F.split(F.col(text), separator)).alias("_pos", "_page"))
    pages = cut.select(key, (F.col("_pos") + 1).alias("page_number"), _page_body(F.col("_page"), keep_newlines).alias("text"))
    n = F.length("text")
    return pages.select(
        key,
        "page_number",
        "text",
        n.alias("extracted_text_length"),
        (n < LOW_TEXT).alias("low_text"),
        F.lit(False).alias("ocr_detected"),
    )


def _page_body(page: Column, keep_newlines: bool) -> Column:
    return normalize_content(page) if keep_newlines else collapse_spaces(page)


def document_preview(text: Column, separator: str = "\f", keep_newlines: bool = False, n: int = PREVIEW) -> Column:
    """``preview_text`` of the pages that ``page_scan`` cuts ``text`` into, where the whole text is at hand.

    Needs no shuffle; pages behind the first ``n`` characters are not cleaned.
    """
    # Each page is preceded by a newline, of which the first one is taken off in the end.
    joined = F.aggregate(
        F.split(text, separator), F.lit(""),
        lambda shown, page: F.when(F.length(shown) > n, shown).otherwise(F.concat(shown, F.lit("\n"), F.left(_page_body(page, keep_newlines), F.lit(n)))),
    )
    return F.substring(joined, 2, n)


def extraction_mode(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document: text, hybrid or scanned, and the number of pages."""
    low = F.count_if(F.col("low_text"))
    total = F.count("*")
    mode = F.when(low == total, "scanned").when(low > 0, "hybrid").otherwise("text")
    return pages.groupBy(key).agg(total.alias("total_pages"), mode.alias("extraction_mode"))


def ocr_mark(pages: DataFrame) -> DataFrame:
    """Low-text pages are flagged; a document without any is left as it is."""
    return pages.withColumn("ocr_detected", F.col("ocr_detected") | F.col("low_text"))


def ocr_logs(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """The two log lines each low-text page leaves for its reviewer."""
    page = F.col("page_number").cast("string")
    requested = F.concat(
        F.lit("Page "), page, F.lit(": text too short ("), F.col("extracted_text_length").cast("string"),
        F.lit(" chars), optical recognition requested."),
    )
    kept = F.concat(F.lit("Page "), page, F.lit(": no recognition engine configured, text kept for review."))
    lines = F.array(
        F.struct(F.lit("info").alias("level"), requested.alias("message")),
        F.struct(F.lit("warn").alias("level"), kept.alias("message")),
    )
    return (
        pages.filter("low_text")
        .select(key, "page_number", F.posexplode(lines).alias("line", "_log"))
        .select(key, "page_number", "line", "_log.level", "_log.message")
    )


def preview_text(pages: DataFrame, key: str = "document_id", n: int = PREVIEW) -> DataFrame:
    """The first ``n`` characters of the page texts joined by newlines.

    Page numbers may start anywhere and have gaps.  A page adds one character at
    least, so of each document the first ``n + 1`` pages in order are enough; the
    rank filter runs before the shuffle.  A running length then drops the pages
    behind the first ``n`` characters and cuts the last one, so what is gathered
    per document is ``n`` characters and no more.
    """
    head = keep_first(pages.select(key, "page_number", F.left("text", F.lit(n)).alias("text")), [key], [F.col("page_number")], n + 1)
    # A null text joins as nothing, without a newline of its own.
    taken = F.when(F.col("text").isNotNull(), F.length("text") + 1).otherwise(0)
    before = F.sum(taken).over(Window.partitionBy(key).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))
    shown = head.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= n)
    part = F.struct("page_number", F.left("text", (F.lit(n) - F.col("_before")).cast("int")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n")
    return shown.groupBy(key).agg(F.left(joined, F.lit(n)).alias("preview"))
