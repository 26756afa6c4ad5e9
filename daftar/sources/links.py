"""Links found on crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import WS, js_trim, url_hash
from daftar.operators.skew import keep_first

ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"
HREF = r"(?is)href\s*=\s*[\"']([^\"']*)[\"']"


def link_discovery(pages: DataFrame, suffix: str | None = ".pdf") -> DataFrame:
    """Candidate files linked from ``pages(page_id, url, html)``, one per target URL.

    ``suffix=None`` takes every link.  A target found on several pages belongs to
    the first of them.
    """
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), 0)).alias("_pos", "_a"))
    href = js_trim(F.regexp_extract("_a", HREF, 1))
    label = F.regexp_replace(F.regexp_replace("_a", "<[^>]*>", " "), WS + "+", " ")
    links = found.select("page_id", "url", "_pos", href.alias("href"), js_trim(label).alias("detected_title"))
    if suffix is not None:
        path = F.lower(F.regexp_replace("href", "[?#].*$", ""))
        links = links.filter(path.endswith(suffix))
    host = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+", 0)
    scheme = F.regexp_extract("url", "^[a-zA-Z]+:", 0)
    folder = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "(?<=[^/:]/)[^/]*$", "")
    target = (
        F.when(F.col("href").rlike("^[a-zA-Z]+:"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(scheme, "href"))
        .when(F.col("href").startswith("/"), F.concat(host, "href"))
        .otherwise(F.concat(folder, "href"))
    )
    out = links.select(
        "page_id",
        "_pos",
        F.md5("url").alias("source_id"),
        F.col("url").alias("source_url"),
        target.alias("pdf_url"),
        url_hash(target).alias("url_hash"),
        F.regexp_replace(F.regexp_replace("href", "[?#].*$", ""), "^.*/", "").alias("filename"),
        "detected_title",
        F.lit("discovered").alias("status"),
    )
    return keep_first(out, ["url_hash"], [F.col("page_id"), F.col("_pos")]).drop("page_id", "_pos")
