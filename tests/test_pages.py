"""Previews of many and of huge pages."""

import pytest
from pyspark.sql import functions as F

from daftar.sources.pages import document_preview, page_scan, preview_text

SCHEMA = "document_id int, page_number int, text string"


@pytest.mark.parametrize("n", [1, 10, 5000])
def test_preview_is_the_begin_of_the_joined_text(spark, n):
    docs = {
        1: ["x"] * 10_000,
        2: ["y" * 40_000, "z" * 40_000, "w"],
        3: ["", "", "a", None, "bc", ""],
        4: [None],
        5: ["q" * (n - 1), "r", "s"],
        6: ["q" * n, "r"],
    }
    rows = [(d, 3 * i + 2, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    got = {r[0]: r[1] for r in preview_text(spark.createDataFrame(rows, SCHEMA).repartition(6), n=n).collect()}
    assert got == {d: "\n".join(t for t in texts if t is not None)[:n] for d, texts in docs.items()}


def test_only_shown_pages_are_gathered(spark):
    rows = [(1, i, "p" * 100) for i in range(2_000)] + [(2, i, "h" * 9_000) for i in range(50)]
    plan = preview_text(spark.createDataFrame(rows, SCHEMA), n=1_000)
    assert {r[0]: len(r[1]) for r in plan.collect()} == {1: 1_000, 2: 1_000}
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Per document one shuffle; rank filter before it, running length behind it.
    assert text.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in text


@pytest.mark.parametrize("keep_newlines", [False, True])
def test_preview_of_a_whole_text_needs_no_shuffle(spark, keep_newlines):
    texts = ["", "\f", "a \t b\fc\r\n\n\n\nd\f\f e ", None, "\f".join(["x"] * 10_000), "y " * 6_000 + "\fz", "w" * 4_999 + "\fv", "w" * 5_000 + "\fv", "  \f" * 40 + "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    want = {r[0]: r[1] for r in preview_text(page_scan(docs, keep_newlines=keep_newlines)).collect()}
    shown = docs.select("document_id", document_preview(F.col("text"), keep_newlines=keep_newlines))
    assert {r[0]: r[1] for r in shown.collect()} == {**want, 3: None}
    assert "Exchange" not in shown._jdf.queryExecution().executedPlan().toString()
