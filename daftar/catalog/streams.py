"""Streaming operators (A-4, J), run over all present input."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.catalog.base import query, table
from daftar.session import scratch_path
from daftar.streaming import file_ingest, flows, levels


def _events(spark, sf):
    return flows.table_stream(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("ingest_stream", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def ingest_stream(spark, sf):
    docs = flows.table_stream(spark, sf, "documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return flows.run_to_table(docs, "ingested")


def _parse_documents(path: str, content: bytes) -> list[tuple]:
    """Rows of a file of JSON lines; a text below 60 characters makes the file a broken one."""
    import json

    rows = [json.loads(line) for line in content.decode().splitlines()]
    if any(len(r.get("text") or "") < 60 for r in rows):
        raise ValueError("a text below 60 characters")
    return [(r["doc_id"], r["text"]) for r in rows]


@query("ingest_files", r"""
SELECT CAST(doc_id // 25 AS BIGINT) AS file, CASE WHEN bool_and(coalesce(length(text), 0) >= 60) THEN 'done' ELSE 'error' END AS status,
  CAST(CASE WHEN bool_and(coalesce(length(text), 0) >= 60) THEN count(*) ELSE 0 END AS BIGINT) AS n_rows,
  CAST(CASE WHEN bool_and(coalesce(length(text), 0) >= 60) THEN sum(length(text)) ELSE 0 END AS BIGINT) AS n_chars
FROM documents GROUP BY 1""")
def ingest_files(spark, sf):
    """All documents as files of up to 25, taken in by a stream; the outcome and what was stored of each file."""
    folder, out = scratch_path(spark, "files"), scratch_path(spark, "taken")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 25).cast("long").alias("file"))
    docs.repartition("file").write.partitionBy("file").json(folder)
    stream = file_ingest.arriving(spark, folder, "*.json", per_batch=100_000)
    file_ingest.ingest_files(stream, _parse_documents, "doc_id long, text string", out, out + "-checkpoint").awaitTermination()
    number = F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file")
    rows = spark.read.schema("path string, doc_id long, text string").parquet(out + "/rows")
    stored = rows.groupBy(number).agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))
    log = spark.read.parquet(out + "/log").select(number, "status")
    return log.join(stored, "file", "left").fillna(0, ["n_rows", "n_chars"]).select("file", "status", "n_rows", "n_chars")


@query("stream_dedup", "SELECT DISTINCT md5(props) AS content_hash FROM events")
def stream_dedup(spark, sf):
    # The log spans 30 days; keys older than that are forgotten.
    rows = _events(spark, sf).select(F.md5("props").alias("content_hash"), "ts")
    return flows.run_to_table(flows.stream_dedup(rows, ["content_hash"], "ts", "31 days").select("content_hash"), "dedup")


_CLAIMS = """(SELECT user_id AS chunk_id, ts, event_type = 'view' AS claim, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt, (SELECT max(ts) FROM events) AS newest FROM events)"""


def _claim_log(df):
    return df.select(F.col("user_id").alias("chunk_id"), F.when(F.col("event_type") == "view", "processing").otherwise("done").alias("status"), "ts")


_EXPIRED = f"""SELECT chunk_id, ts AS claimed_at, 'pending' AS status FROM {_CLAIMS}
WHERE claim AND CASE WHEN nxt IS NULL THEN newest - ts >= INTERVAL 10 MINUTE ELSE nxt - ts > INTERVAL 10 MINUTE END"""


# The stream knows what happened up to its watermark, 10 minutes before the newest event.
@query("stream_claim_timeout", f"""SELECT chunk_id, ts AS claimed_at, 'pending' AS status FROM {_CLAIMS}
WHERE claim AND ts + INTERVAL 10 MINUTE <= newest - INTERVAL 10 MINUTE AND (nxt IS NULL OR nxt - ts > INTERVAL 10 MINUTE)""")
def stream_claim_timeout(spark, sf):
    return flows.run_to_table(flows.stream_claim_timeout(_claim_log(_events(spark, sf))), "claims")


@query("expired_claims", _EXPIRED)
def expired_claims(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.expired_claims(_claim_log(events))


@query("stream_status_counts", "SELECT event_type AS status, count(*) AS total FROM events GROUP BY 1")
def stream_status_counts(spark, sf):
    counts = flows.stream_status_counts(_events(spark, sf).withColumnRenamed("event_type", "status"))
    return flows.latest_updates(flows.run_to_table(counts, "counts", "update"), "status")


_NEWEST = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query("stream_upsert", _NEWEST)
def stream_upsert(spark, sf):
    log = _events(spark, sf).select("user_id", "event_id", "event_type", "ts")
    path = scratch_path(spark, "upsert")
    version = [F.col("ts").desc(), F.col("event_id").desc()]
    flows.stream_upsert(log, path, path + "-checkpoint", ["user_id"], version).awaitTermination()
    flows.compact(spark, path, path + "-table", ["user_id"], version)
    return spark.read.parquet(path + "-table/batch_id=-1").select("user_id", "event_id", "event_type")


@query("stream_upsert_levels", _NEWEST)
def stream_upsert_levels(spark, sf):
    """The same table from a stream of ten batches, kept in levels of three runs."""
    source, path = scratch_path(spark, "level-input"), scratch_path(spark, "levels")
    table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts").repartition(10, "event_id").write.parquet(source)
    version = [F.col("ts").desc(), F.col("event_id").desc()]
    batches = flows.table_stream(spark, source, "*.parquet", files_per_trigger=1)
    levels.stream_upsert(batches, path, path + "-checkpoint", ["user_id"], version, fan=3).awaitTermination()
    return levels.read(spark, path, ["user_id"], version).select("user_id", "event_id", "event_type")


@query("stream_job_state", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS ts FROM events GROUP BY 1")
def stream_job_state(spark, sf):
    jobs = _events(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "event_id")
    return flows.latest_updates(flows.run_to_table(flows.stream_job_state(jobs), "jobs", "update"), "job_id")


# States in their order, dealt out so that some jobs go a long way and some steps are not legal.
_STATES = [*flows.JOB_STEPS]
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, nexts in flows.JOB_STEPS.items() for b in nexts)
_ALWAYS = ", ".join(f"'{x}'" for x in flows.JOB_ALWAYS)
_STEPS = f"""WITH RECURSIVE e AS (
  SELECT user_id AS job_id, ts, event_id AS tie, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE WHEN event_id % 7 = 0 THEN 'pending' WHEN event_id % 11 = 0 THEN 'failed' ELSE ({_STATES})[1 + event_id % 9] END AS status
  FROM events WHERE epoch_us(ts) <= (SELECT (epoch_us(max(ts)) - 600000000) // 1000 * 1000 FROM events)
), r AS (
  SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS tie, CAST(NULL AS VARCHAR) AS status,
    CAST(NULL AS VARCHAR) AS previous, CAST(NULL AS VARCHAR) AS state, false AS legal FROM e
  UNION ALL
  SELECT job_id, n, ts, tie, status, state, CASE WHEN ok THEN status ELSE state END, ok FROM (
    SELECT e.job_id, e.n, e.ts, e.tie, e.status, r.state, CASE WHEN r.state IS NULL THEN e.status = 'pending'
      ELSE e.status IN ({_ALWAYS}) OR (r.state, e.status) IN ({_PAIRS}) END AS ok
    FROM r JOIN e ON e.job_id = r.job_id AND e.n = r.n + 1)
)"""


def _job_steps(spark, sf):
    at = F.col("event_id")
    status = F.when(at % 7 == 0, "pending").when(at % 11 == 0, "failed").otherwise(F.get(F.array(*map(F.lit, _STATES)), (at % 9).cast("int")))
    jobs = _events(spark, sf).select(F.col("user_id").alias("job_id"), status.alias("status"), "ts", "event_id")
    return flows.run_to_table(flows.stream_job_steps(jobs), "job-steps")


@query("stream_job_steps", _STEPS + " SELECT job_id, ts, tie, status, coalesce(previous, '') AS previous, legal FROM r WHERE n > 0")
def stream_job_steps(spark, sf):
    return _job_steps(spark, sf).withColumn("previous", F.coalesce("previous", F.lit("")))


@query("stream_current_states", _STEPS + " SELECT job_id, arg_max(status, n) AS status, max(ts) AS ts FROM r WHERE legal GROUP BY 1")
def stream_current_states(spark, sf):
    return flows.current_states(_job_steps(spark, sf))


@query("recent_activity", "SELECT time_bucket(INTERVAL 2 MINUTE, ts) AS window_start, count(*) FILTER (WHERE event_type = 'view') AS pending FROM events GROUP BY 1")
def recent_activity(spark, sf):
    rows = _events(spark, sf).select("ts", F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type")).alias("status"))
    return flows.latest_updates(flows.run_to_table(flows.recent_activity(rows), "activity", "update"), "window_start")
