"""Line de-duplication by site-relative frequency.

A line is boilerplate of a host if the share of the host's pages that contain it
is above ``ratio`` and it stands on at least ``min_pages`` of them.  Boilerplate
lines are dropped from the host's pages, other lines stay as they are.

Everything is DataFrame functions.  Lines travel as 64-bit hashes and are counted
before the shuffle.  A host has at most (mean lines per page / ratio) boilerplate
lines, so their list per host is short whatever the host's size; whether it is
broadcast or joined is left to Spark, which looks at its size.

Nulls and edge cases: a null host is a host of its own; a null text stays null
and counts as a page; lines without a word are neither counted nor dropped; a
line counts once per page, however often it stands there; repeated rows are
pages each; an empty table gives an empty result; a text whose lines all go
becomes empty, its row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import SPACE, durable, fresh

RATIO = 0.1
MIN_PAGES = 10


def _hash_of(line: Column) -> Column:
    """Hash of a line without its outer white space; null for a line without a word."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines."""
    slim = pages.select(F.col(host).alias("host"), F.array_distinct(F.transform(_lines(F.col("text").cast("string")), _hash_of)).alias("hashes"))
    # One pass: the page itself is counted under a null hash, for the host's total.
    marks = F.concat(F.array(F.lit(None).cast("long")), F.coalesce(F.filter("hashes", lambda h: h.isNotNull()), F.array().cast("array<bigint>")))
    counts = durable(slim.select("host", F.explode(marks).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("line").isNull() | (F.col("n") >= min_pages)), "lines")
    totals = counts.filter("line IS NULL").select(F.col("host").alias("_host"), F.col("n").alias("pages"))
    common = counts.filter("line IS NOT NULL").join(totals, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with cleaned ``text`` and two more columns, ``n_lines`` and ``n_dropped``.

    Columns of these names that the input has are replaced.
    """
    # Written first: Spark then knows the lists' size when it plans the join, and texts are shuffled only if it is large.
    lists = durable(boilerplate(pages, host, ratio, min_pages), "boilerplate").select(F.col("host").alias("_host"), F.col("lines").alias("_bad"))
    key, bad = fresh(pages, "_host"), fresh(pages, "_bad")
    lists = lists.withColumnsRenamed({"_host": key, "_bad": bad})
    joined = pages.join(lists, F.col(host).eqNullSafe(F.col(key)), "left")
    lines = _lines(F.col("text").cast("string"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(bad), _hash_of(x)), F.lit(False)))
    text = F.when(F.col(bad).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(lines), F.lit(0))
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"),
        "n_dropped": F.when(F.col("text").isNull() | F.col(bad).isNull(), 0).otherwise(n - F.size(kept)).cast("long"),
        "text": text,
    }).drop(key, bad)
