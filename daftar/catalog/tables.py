"""Sources, sinks, filters and projections (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar import schema
from daftar.catalog.base import (
    CHUNKS, EVENTS, PAGES, WS, chunks, event_log, pages, query, s_re, s_trim, table,
)
from daftar.functions import data, text
from daftar.operators import edit, filters
from daftar.session import scratch_path
from daftar.sources import files, keyed_store, links
from daftar.sources import pages as page_source
from daftar.sources import stores


@query("file_inventory")
def file_inventory(spark, sf):
    """The data folder itself, listed like an ingest folder (Parquet in place of PDF)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(sf)
    return files.listing(found).select("filename", "file_size", "status")


@query("page_scan", f"SELECT * FROM {PAGES}")
def page_scan(spark, sf):
    return pages(spark, sf)


@query("wash_text", f"SELECT doc_id, {s_trim('replace(text, chr(0), chr(32))')} AS washed FROM documents".replace("chr(32)", "''"))
def wash_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.wash_text(F.col("text")).alias("washed"))


_HREF = r"href\s*=\s*[\"'']([^\"'']*)[\"'']"


@query("link_discovery", rf"""
WITH a AS (SELECT page_id, url, generate_subscripts(m, 1) AS pos, unnest(m) AS tag FROM
  (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>') AS m FROM pages)),
b AS (SELECT page_id, url, pos, {s_trim(f"regexp_extract(tag, '(?is){_HREF}', 1)")} AS href,
  {s_trim(s_re(s_re('tag', '<[^>]*>', "' '"), WS + '+', "' '"))} AS detected_title FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z]+:') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-zA-Z]+:') || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') || href
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:]/)[^/]*$', '\1') || href END AS pdf_url FROM b)
SELECT md5(url) AS source_id, url AS source_url, pdf_url, md5(pdf_url) AS url_hash,
  regexp_replace(regexp_replace(href, '[?#].*$', ''), '^.*/', '') AS filename, detected_title, 'discovered' AS status
FROM (SELECT *, row_number() OVER (PARTITION BY pdf_url ORDER BY page_id, pos) AS r FROM c) WHERE r = 1""")
def link_discovery(spark, sf):
    return links.link_discovery(table(spark, sf, "pages"), suffix=None)


@query("safe_filename", f"""SELECT page_id, {s_re(s_re("regexp_extract(rtrim(url_decode(replace(url, '+', '%2B')), '/'), '[^/]*$')", r'[^A-Za-z0-9_.\-\s\x0B\x{FEFF}\p{Z}\x{0600}-\x{06FF}]', "'_'"), 'QQ', "''")} AS safe FROM pages""")
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_filename(F.col("url")).alias("safe"))


@query("insert_if_absent", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS r FROM conversations)
WHERE r = 1 AND text NOT IN (SELECT text FROM conversations WHERE role = 'system')""")
def insert_if_absent(spark, sf):
    turns = table(spark, sf, "conversations")
    stored = turns.filter("role = 'system'")
    return stores.insert_if_absent(turns, stored, ["text"], [F.col("conv_id"), F.col("turn")])


@query("upsert", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert(spark, sf):
    log = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    new, store = log.filter("event_type = 'purchase'"), log.filter("event_type <> 'purchase'")
    return stores.upsert(new, store, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


@query("keyed_upsert", """
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def keyed_upsert(spark, sf):
    """The store on files after two upserts, the second one repeated under its name."""
    log = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    path, by = scratch_path(spark, "keyed-store"), ["ts", "event_id"]
    keyed_store.create(log.filter("event_type not in ('purchase', 'click')"), path, ["user_id"], by)
    keyed_store.upsert(log.filter("event_type = 'purchase'"), path, ["user_id"], by)
    for _ in range(2):
        keyed_store.upsert(log.filter("event_type = 'click'"), path, ["user_id"], by, batch="clicks")
    return keyed_store.read(spark, path).select("user_id", "event_id", "event_type")


@query("conditional_update", f"""
SELECT chunk_id, CASE WHEN embedding IS NULL AND embedding_status IN ('failed', 'processing') THEN 'pending' ELSE embedding_status END AS embedding_status,
  CASE WHEN embedding IS NULL AND embedding_status IN ('failed', 'processing') THEN NULL ELSE embedding_claimed_at END AS embedding_claimed_at
FROM {CHUNKS}""")
def conditional_update(spark, sf):
    stuck = F.col("embedding").isNull() & F.col("embedding_status").isin("failed", "processing")
    out = edit.conditional_update(
        chunks(spark, sf), stuck, {"embedding_status": F.lit("pending"), "embedding_claimed_at": F.lit(None)}
    )
    return out.select("chunk_id", "embedding_status", "embedding_claimed_at")


_NO_GRADE, _NO_SUBJECT = "(md_grade IS NULL OR md_grade = 'null')", "(md_subject IS NULL OR md_subject = 'null')"


@query("conditional_delete", f"""
SELECT chunk_id, document_id FROM {CHUNKS}
WHERE NOT coalesce(content IS NULL OR length({s_trim('content')}) < 50, false) AND NOT ({_NO_GRADE} OR {_NO_SUBJECT})""")
def conditional_delete(spark, sf):
    kept = edit.conditional_delete(chunks(spark, sf), edit.broken_content())
    return edit.conditional_delete(kept, edit.unclassified()).select("chunk_id", "document_id")


@query("backfill", f"""
SELECT chunk_id, coalesce(content_hash, md5(content)) AS content_hash, coalesce(original_content, content) AS original_content,
  coalesce(updated_at, created_at) AS updated_at, coalesce(chunk_index, 0) AS chunk_index,
  CASE WHEN embedding_status IS NULL OR embedding_status = 'pending' THEN CASE WHEN embedding IS NOT NULL THEN 'done' ELSE 'pending' END
       ELSE embedding_status END AS embedding_status
FROM {CHUNKS}""")
def backfill(spark, sf):
    return edit.backfill(chunks(spark, sf)).select(
        "chunk_id", "content_hash", "original_content", "updated_at", "chunk_index", "embedding_status"
    )


def _sync(spark, sf):
    log = event_log(spark, sf)
    vector = F.array(F.col("value").cast("float"))
    local = log.filter("embedding_status <> 'pending'").select(
        "chunk_id", F.col("props").alias("content"), vector.alias("embedding"),
        F.when(F.col("embedding_status") == "done", "embedded").otherwise("uploaded").alias("status"),
    )
    remote = log.select(
        "chunk_id", F.col("props").alias("content"), F.lit(None).cast("array<float>").alias("embedding"),
        F.coalesce("embedding_status", F.lit("pending")).alias("embedding_status"),
    )
    return stores.sync_delta(local, remote)


@query("sync_delta", f"""
SELECT chunk_id, 'remote' AS side, CASE WHEN embedding_status = 'done' THEN 'done' ELSE coalesce(embedding_status, 'pending') END AS status,
  embedding_status IS NOT DISTINCT FROM 'done' AS has_vector FROM {EVENTS}
UNION ALL
SELECT chunk_id, 'local', 'uploaded', true FROM {EVENTS} WHERE embedding_status <> 'pending'
UNION ALL
SELECT chunk_id, 'local', 'pending', false FROM {EVENTS} WHERE coalesce(embedding_status, 'pending') = 'pending'""")
def sync_delta(spark, sf):
    remote, local = _sync(spark, sf)
    has = F.col("embedding").isNotNull().alias("has_vector")
    a = remote.select("chunk_id", F.lit("remote").alias("side"), F.col("embedding_status").alias("status"), has)
    return a.unionByName(local.select("chunk_id", F.lit("local").alias("side"), "status", has))


def _uploads(spark, sf):
    """Files as described by the orders table: amounts as sizes, priorities as types."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("file_id"),
        F.concat(F.lit("/inbox/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_path"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(F.col("o_orderpriority") == "5-LOW", "text/html").otherwise("application/pdf").alias("mime_type"),
        (F.col("o_totalprice") * 200).cast("long").alias("file_size"),
        F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("topic"), F.col("o_orderpriority"), F.lit("gradeLabel"), F.col("o_orderstatus")))
        .when(F.col("o_orderstatus") == "O", F.create_map(F.lit("topicTitle"), F.col("o_orderpriority"), F.lit("subject"), F.col("o_orderstatus")))
        .alias("metadata"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


@query("file_validate", """
SELECT file_id, reject_reason, reject_reason IS NULL AS accepted FROM (
  SELECT o_orderkey AS file_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'type'
    WHEN CAST(trunc(o_totalprice * 200) AS BIGINT) > 62914560 THEN 'size' END AS reject_reason FROM orders)""")
def file_validate(spark, sf):
    return files.file_validate(_uploads(spark, sf)).select("file_id", "reject_reason", "accepted")


@query("register_documents", """
SELECT md5('/inbox/' || o_orderkey || '.pdf') AS document_id, o_orderkey || '.pdf' AS filename,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority END AS title,
  CASE WHEN o_orderstatus = 'F' THEN 'F' END AS detected_grade_name,
  CASE WHEN o_orderstatus = 'O' THEN 'O' END AS detected_subject_name,
  md5('job:' || md5('/inbox/' || o_orderkey || '.pdf')) AS job_id, 'pending' AS status, 0 AS retry_count, o_orderdate AS created_at
FROM orders""")
def register_documents(spark, sf):
    documents, jobs = files.register_documents(_uploads(spark, sf))
    cols = documents.select("document_id", "filename", "title", "detected_grade_name", "detected_subject_name")
    return cols.join(jobs.select("document_id", "job_id", "status", "retry_count", "created_at"), "document_id")


@query("filter_chunks", f"""
SELECT chunk_id, document_id, repair_status, quality_score, updated_at FROM {CHUNKS}
WHERE repair_status = 'clean' AND quality_score >= 0.9 ORDER BY updated_at DESC NULLS LAST, chunk_id LIMIT 500""")
def filter_chunks(spark, sf):
    return filters.filter_chunks(chunks(spark, sf), status="clean", min_quality=0.9, limit=500).select(
        "chunk_id", "document_id", "repair_status", "quality_score", "updated_at"
    )


@query("to_boolean_filter", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'true' WHEN 'click' THEN 'false' END AS flag FROM events""")
def to_boolean_filter(spark, sf):
    kind = F.col("event_type")
    word = F.when(kind == "view", "true").when(kind == "click", "false").when(kind == "error", "yes").otherwise("1")
    return table(spark, sf, "events").select("event_id", text.to_boolean_filter(word).cast("string").alias("flag"))


@query("min_content_gate", f"SELECT document_id, page_number FROM {PAGES} WHERE length({s_trim('text')}) >= 50")
def min_content_gate(spark, sf):
    return filters.min_content_gate(pages(spark, sf)).select("document_id", "page_number")


@query("embed_viability", f"""
SELECT chunk_id, CASE WHEN coalesce(length({s_trim('content')}), 0) < 100 THEN 'skipped' ELSE 'claimable' END AS embedding_status
FROM {CHUNKS} WHERE embedding IS NULL AND (embedding_status IS NULL OR embedding_status IN ('pending', 'failed'))""")
def embed_viability(spark, sf):
    return filters.embed_viability(chunks(spark, sf)).select("chunk_id", "embedding_status")


@query("embed_eligible", f"""
SELECT chunk_id, repair_status FROM {CHUNKS}
WHERE is_active AND repair_status IN ('clean', 'embedded', 'auto_repaired') AND content_hash IS NOT NULL""")
def embed_eligible(spark, sf):
    return filters.embed_eligible(chunks(spark, sf)).select("chunk_id", "repair_status")


@query("metadata_null_predicate", f"SELECT chunk_id, {_NO_GRADE} AS no_grade, {_NO_SUBJECT} AS no_subject FROM {CHUNKS}")
def metadata_null_predicate(spark, sf):
    m = F.col("metadata")
    return chunks(spark, sf).select(
        "chunk_id", data.metadata_null(m, "grade").alias("no_grade"), data.metadata_null(m, "subject").alias("no_subject")
    )


@query("metadata_null_json", "SELECT event_id, (props->>'$.k' IS NULL OR props->>'$.k' = 'null') AS no_k, (props->>'$.grade' IS NULL OR props->>'$.grade' = 'null') AS no_grade FROM events")
def metadata_null_json(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select(
        "event_id", data.metadata_null(p, "k", json=True).alias("no_k"), data.metadata_null(p, "grade", json=True).alias("no_grade")
    )


@query("allowed_choice", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE lower(trim(c_mktsegment)) IN (SELECT lower(c_mktsegment) FROM customer WHERE c_acctbal > 9950)""")
def allowed_choice(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    choices = customers.filter("c_acctbal > 9950").select(F.lower("c_mktsegment").alias("name"))
    return filters.allowed_choice(customers.drop("c_acctbal"), "c_mktsegment", choices, "name")


def _candidates(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("candidate_id"),
        F.when(F.col("o_orderstatus") == "P", "discovered").when(F.col("o_orderstatus") == "F", "approved").otherwise("queued").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("detected_grade"),
    )


@query("candidate_filter", "SELECT o_orderkey AS candidate_id, 'approved' AS status, o_orderpriority AS detected_grade FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def candidate_filter(spark, sf):
    return filters.candidate_filter(_candidates(spark, sf), "approved", "1-URGENT")


@query("distinct_grades", "SELECT DISTINCT o_orderpriority AS detected_grade FROM orders WHERE o_orderpriority <> '5-LOW'")
def distinct_grades(spark, sf):
    return filters.distinct_grades(_candidates(spark, sf))


@query("vector_gap", f"SELECT chunk_id FROM {CHUNKS} WHERE embedding IS NULL ORDER BY chunk_id LIMIT 100")
def vector_gap(spark, sf):
    return filters.vector_gap(chunks(spark, sf), limit=100).select("chunk_id")


@query("enum_check", f"""
SELECT chunk_id, 'embedding_status_missing' AS rule FROM {CHUNKS} WHERE embedding_status IS NULL
UNION ALL SELECT chunk_id, 'content_hash_missing' FROM {CHUNKS} WHERE content_hash IS NULL
UNION ALL SELECT chunk_id, 'language_not_allowed' FROM {CHUNKS} WHERE language NOT IN ('ar', 'fr', 'en')""")
def enum_check(spark, sf):
    enums = {"embedding_status": schema.EMBEDDING_STATUS, "repair_status": schema.REPAIR_STATUS, "language": ["ar", "fr", "en"]}
    return filters.enum_check(chunks(spark, sf), "chunk_id", enums, ["embedding_status", "content_hash"])


@query("project", f"SELECT chunk_id, document_id, md_filename AS filename FROM {CHUNKS} ORDER BY created_at DESC, chunk_id LIMIT 10")
def project(spark, sf):
    cols = ["chunk_id", "document_id", F.col("metadata")["filename"].alias("filename")]
    return filters.project(chunks(spark, sf), cols, [F.col("created_at").desc(), F.col("chunk_id")], 10)


@query("ocr_mark", f"SELECT document_id, page_number, low_text AS ocr_detected FROM {PAGES}")
def ocr_mark(spark, sf):
    return page_source.ocr_mark(pages(spark, sf)).select("document_id", "page_number", "ocr_detected")


@query("ocr_logs", f"""
SELECT document_id, page_number, CAST(line AS INTEGER) AS line, CASE line WHEN 0 THEN 'info' ELSE 'warn' END AS level,
  CASE line WHEN 0 THEN 'Page ' || page_number || ': text too short (' || extracted_text_length || ' chars), optical recognition requested.'
       ELSE 'Page ' || page_number || ': no recognition engine configured, text kept for review.' END AS message
FROM {PAGES}, (VALUES (0), (1)) v(line) WHERE low_text""")
def ocr_logs(spark, sf):
    return page_source.ocr_logs(pages(spark, sf))


@query("preview_text", f"""
SELECT document_id, left(string_agg(text, chr(10) ORDER BY page_number), 5000) AS preview FROM {PAGES} GROUP BY document_id""")
def preview_text(spark, sf):
    # Numbers with wide gaps: only their order may count.
    return page_source.preview_text(pages(spark, sf).withColumn("page_number", F.col("page_number") * 7919))


@query("extraction_mode", f"""
SELECT document_id, count(*) AS total_pages, CASE WHEN count(*) FILTER (WHERE low_text) = count(*) THEN 'scanned'
  WHEN count(*) FILTER (WHERE low_text) > 0 THEN 'hybrid' ELSE 'text' END AS extraction_mode FROM {PAGES} GROUP BY document_id""")
def extraction_mode(spark, sf):
    return page_source.extraction_mode(pages(spark, sf))


