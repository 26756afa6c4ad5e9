"""Ordered and stateful-by-key operators (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.catalog import base
from daftar.catalog.aggregates import _TESTS, _tests
from daftar.catalog.base import EVENTS, PAGES, query, table
from daftar.operators import chunking, dedup, edit, health

_LINES = f"(SELECT document_id, page_number AS chunk_index, md5(text) AS content_hash FROM {PAGES})"


def _lines(spark, sf):
    """Every line of a document as a chunk of its source group."""
    return base.pages(spark, sf).select("document_id", F.col("page_number").alias("chunk_index"), F.md5("text").alias("content_hash"))


@query("mark_duplicates_in_document", f"""
SELECT document_id, chunk_index, content_hash, r > 1 OR content_hash = md5('') AS is_duplicate FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, content_hash ORDER BY chunk_index) AS r FROM {_LINES})""")
def mark_duplicates_in_document(spark, sf):
    lines = _lines(spark, sf)
    # Stored already: the hash of the empty line, for every document that has one.
    existing = lines.filter(F.col("content_hash") == F.md5(F.lit("")))
    return dedup.mark_duplicates_in_document(lines, existing)


@query("dedup_global", """
SELECT chunk_id, content_hash, s < chunk_id AS is_duplicate, CASE WHEN s < chunk_id THEN s END AS duplicate_of FROM (
  SELECT doc_id AS chunk_id, md5(text) AS content_hash, min(doc_id) OVER (PARTITION BY md5(text)) AS s FROM documents)""", as_text=("duplicate_of",))
def dedup_global(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("content_hash"))
    return dedup.dedup_global(d)


_EDITS = "(SELECT user_id AS chunk_id, event_id AS edit_id, ts AS edited_at, event_type AS content FROM events)"


@query("chunk_versions", f"""
WITH c AS (SELECT c_custkey AS chunk_id, 'view' AS content, 2 AS version_index FROM customer),
e AS (SELECT e.*, coalesce(lag(e.content) OVER (PARTITION BY e.chunk_id ORDER BY edited_at, edit_id), c.content) AS before, c.version_index AS base
  FROM {_EDITS} e JOIN c USING (chunk_id))
SELECT chunk_id, CAST(base + row_number() OVER (PARTITION BY chunk_id ORDER BY edited_at, edit_id) AS INTEGER) AS version_index,
  before AS content, md5(before) AS content_hash, edited_at AS created_at FROM e WHERE before <> content""")
def chunk_versions(spark, sf):
    edits = table(spark, sf, "events").select(
        F.col("user_id").alias("chunk_id"), F.col("event_id").alias("edit_id"), F.col("ts").alias("edited_at"), F.col("event_type").alias("content")
    )
    current = table(spark, sf, "customer").select(F.col("c_custkey").alias("chunk_id"), F.lit("view").alias("content"), F.lit(2).alias("version_index"))
    return edit.chunk_versions(edits, current)


@query("active_embedding", """
SELECT chunk_id, embedding_id, r = 1 AS is_active FROM (
  SELECT user_id AS chunk_id, event_id AS embedding_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)""")
def active_embedding(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("embedding_id"), F.col("ts").alias("created_at"))
    return health.active_embedding(rows).drop("created_at")


@query("topk_similar", f"SELECT query_id, ids, scores, passed FROM {_TESTS}")
def topk_similar(spark, sf):
    tests, _ = _tests(spark, sf)
    scores = F.array_join(F.transform("retrieved_scores", lambda x: x.cast("string")), ",")
    ids = F.array_join(F.transform("retrieved_chunk_ids", lambda x: x.cast("string")), ",")
    return tests.select("query_id", ids.alias("ids"), scores.alias("scores"), "passed")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf):
    e = table(spark, sf, "events")
    return health.latest_per_key(e, "user_id", F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")


@query("backfill_classification", f"""
WITH p AS (SELECT document_id, page_number, md5(text) AS grade, sha256(text) AS subject, length(text) >= 200 AS ok FROM {PAGES}),
c AS (SELECT document_id, arg_min(grade, page_number) AS grade, arg_min(subject, page_number) AS subject FROM p WHERE ok GROUP BY 1)
SELECT p.document_id, p.page_number, c.grade, c.subject FROM p JOIN c USING (document_id)""")
def backfill_classification(spark, sf):
    text = F.col("text")
    rows = base.pages(spark, sf).select(
        "document_id", "page_number", F.md5(text).alias("grade"), F.sha2(text, 256).alias("subject"), (F.length(text) >= 200).alias("is_valid")
    )
    return health.backfill_classification(rows).drop("is_valid")


@query("dimension_check", """
SELECT vec_id, len(embedding) = 64 - label % 2 AS dim_ok, CAST(len(embedding[1:48]) AS INTEGER) AS cut_dim FROM embeddings""".replace("64 - label % 2", "64"))
def dimension_check(spark, sf):
    e = health.dimension_check(table(spark, sf, "embeddings"), 64)
    cut = health.dimension_check(table(spark, sf, "embeddings"), 48, truncate=True).select("vec_id", F.size("embedding").alias("cut_dim"))
    return e.select("vec_id", "dim_ok").join(cut, "vec_id")


_RANKS = "(SELECT r_name AS grade_id, 10 - r_regionkey AS rank FROM region WHERE r_regionkey > 1)"


@query("priority_batch", f"""
WITH w AS (SELECT o_orderkey AS chunk_id, r_name AS grade_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P')
SELECT chunk_id, grade_id, rank FROM w LEFT JOIN {_RANKS} USING (grade_id)
WHERE rank IS NOT DISTINCT FROM (SELECT min(rank) FROM w LEFT JOIN {_RANKS} USING (grade_id)) ORDER BY chunk_id LIMIT 128""")
def priority_batch(spark, sf):
    o, c = table(spark, sf, "orders").filter("o_orderstatus = 'P'"), table(spark, sf, "customer")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    work = (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("o_orderkey").alias("chunk_id"), F.col("r_name").alias("grade_id"))
    )
    ranks = r.filter("r_regionkey > 1").select(F.col("r_name").alias("grade_id"), (10 - F.col("r_regionkey")).alias("rank"))
    return health.priority_batch(work, ranks, 128)


_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


@query("stale_claims", f"""
SELECT chunk_id, CASE WHEN embedding_status = 'processing' AND ts < {_NOW} - INTERVAL 10 MINUTE THEN 'pending' ELSE embedding_status END AS embedding_status FROM {EVENTS}""")
def stale_claims(spark, sf):
    log = base.event_log(spark, sf).withColumn("embedding_claimed_at", F.col("ts"))
    return health.stale_claims(log, F.lit("2024-01-20 12:00:00").cast("timestamp")).select("chunk_id", "embedding_status")


@query("ingest_active", f"""
SELECT processing, recent, processing > 0 OR recent > 0 AS active FROM (SELECT count(*) FILTER (WHERE embedding_status = 'processing') AS processing,
  count(*) FILTER (WHERE (embedding_status IS NULL OR embedding_status = 'pending') AND ts >= {_NOW} - INTERVAL 2 MINUTE) AS recent FROM {EVENTS})""")
def ingest_active(spark, sf):
    log = base.event_log(spark, sf).withColumn("created_at", F.col("ts"))
    return health.ingest_active(log, F.lit("2024-01-20 12:00:00").cast("timestamp"))


_SENTENCES = f"""(SELECT document_id, page_number, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS page_chunk_index, length(unnest(p)) AS n
  FROM (SELECT document_id, page_number, string_split(text, '. ') AS p FROM {PAGES}))"""


@query("document_index", f"""
SELECT document_id, page_number, page_chunk_index, CAST(n AS INTEGER) AS n,
  CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_chunk_index) - 1 AS INTEGER) AS chunk_index FROM {_SENTENCES}""")
def document_index(spark, sf):
    rows = base.pages(spark, sf).select("document_id", "page_number", F.posexplode(F.split("text", r"\. ", -1)).alias("chunk_index", "c"))
    return chunking.document_index(rows.withColumn("n", F.length("c")).drop("c"))


