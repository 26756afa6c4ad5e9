"""Registered queries against their check SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tools import check  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "page_scan", "link_discovery", "sync_delta", "enum_check", "ocr_logs", "alias_ngram_join", "alias_fuzzy_join", "resolve_fallback",
    "slug_match_join", "missing_combinations", "cosine_pairs", "null_diagnosis", "planner_steps", "curriculum_tree", "chunk_versions",
    "mark_duplicates_in_document", "topk_similar", "document_index", "cleanup_topic", "parse_filename_hints", "chunk_window", "chunk_pages", "chunk_pages_split", "chunk_paragraph",
    "chunk_quality_rollup", "repair_chunks", "apply_edits", "generate_qa", "cleanup_report", "stream_claim_timeout",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_names_fit():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 130
    assert set(SAMPLE) <= set(sql)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.rows(got) == check.rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
