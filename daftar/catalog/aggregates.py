"""Aggregations (D) and ordered listings (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.catalog import base
from daftar.catalog.base import (
    CHUNKS, CURRICULA, CYCLES, EVENTS, EXAMS, EXERCISES, GRADES, MAPPED, OUTLINES, SECTIONS, SUBJECTS, TOPICS, TRACKS,
    TRACK_SUBJECTS, query, s_cosine, table,
)
from daftar.operators import curriculum, health, resolve, retrieval
from daftar.sources import files

_NO_GRADE, _NO_SUBJECT = "(md_grade IS NULL OR md_grade = 'null')", "(md_subject IS NULL OR md_subject = 'null')"


@query("status_counts", f"SELECT coalesce(embedding_status, 'null') AS embedding_status, count(*) AS total, count(embedding) AS with_embedding FROM {CHUNKS} GROUP BY 1")
def status_counts(spark, sf):
    return health.status_counts(base.chunks(spark, sf))


@query("null_diagnosis", f"""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE content IS NULL) AS null_content, count(*) FILTER (WHERE content_hash IS NULL) AS null_hash,
  count(*) FILTER (WHERE embedding IS NULL) AS null_embedding, count(*) FILTER (WHERE source_id IS NULL) AS null_source_id,
  count(*) FILTER (WHERE embedding_status IS NULL) AS null_status, count(*) FILTER (WHERE embedding_status = 'failed') AS failed_status,
  count(*) FILTER (WHERE {_NO_GRADE}) AS null_grade, count(*) FILTER (WHERE {_NO_SUBJECT}) AS null_subject FROM {CHUNKS}""")
def null_diagnosis(spark, sf):
    return health.null_diagnosis(base.chunks(spark, sf))


@query("health_check", f"""
SELECT count(*) AS total_chunks, count(*) FILTER (WHERE content <> '') AS with_content, count(embedding) AS with_embedding,
  count(*) FILTER (WHERE embedding_status = 'done') AS status_done, count(*) FILTER (WHERE embedding_status = 'pending') AS status_pending,
  count(*) FILTER (WHERE embedding_status = 'failed') AS status_failed, count(*) FILTER (WHERE document_id IS NULL) AS missing_document_id FROM {CHUNKS}""")
def health_check(spark, sf):
    return health.health_check(base.chunks(spark, sf))


@query("unclassified_by_file", f"SELECT md_filename AS filename, count(*) AS rows_to_drop FROM {CHUNKS} WHERE {_NO_GRADE} AND {_NO_SUBJECT} GROUP BY 1")
def unclassified_by_file(spark, sf):
    return health.unclassified_by_file(base.chunks(spark, sf)).orderBy(F.col("rows_to_drop").desc(), "filename")


@query("status_missing_report", f"""
SELECT embedding_status, count(*) AS total, count(*) FILTER (WHERE embedding IS NULL) AS missing_vector,
  count(*) FILTER (WHERE source_id IS NULL) AS missing_source_id FROM {CHUNKS} GROUP BY 1""")
def status_missing_report(spark, sf):
    return health.status_missing_report(base.chunks(spark, sf))


@query("ingest_counters", f"""
SELECT document_id, count(*) FILTER (WHERE content_hash IS NOT NULL) AS inserted,
  count(*) FILTER (WHERE content_hash IS NOT NULL AND embedding IS NOT NULL) AS embedded,
  count(*) FILTER (WHERE content_hash IS NULL AND is_active) AS skipped, count(*) FILTER (WHERE content_hash IS NULL AND NOT is_active) AS skipped_short FROM {CHUNKS} GROUP BY 1""")
def ingest_counters(spark, sf):
    rows = base.chunks(spark, sf).withColumn("outcome", F.when(F.col("content_hash").isNotNull(), "inserted").when(F.col("is_active"), "skipped").otherwise("skipped_short"))
    return health.ingest_counters(rows, "document_id")


@query("file_progress", """
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS error,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS pending,
  CAST(round(100.0 * count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) / count(*)) AS INTEGER) AS percent FROM orders""")
def file_progress(spark, sf):
    end = F.when(F.col("o_orderstatus") == "F", ".done.pdf").when(F.col("o_orderstatus") == "P", ".error.pdf").otherwise(".pdf")
    name = F.concat(F.col("o_orderkey").cast("string"), end)
    return health.file_progress(table(spark, sf, "orders").select(files.file_status(name).alias("status")))


_KEY_COVER = """CAST(least(round(100.0 * (SELECT count(DISTINCT {k}) FROM {c} WHERE {k} IN (SELECT {k} FROM {p})) / (SELECT count(DISTINCT {k}) FROM {p})), 100) AS INTEGER)"""


@query("coverage_score", f"""
SELECT (SELECT count(DISTINCT topic_id) FROM {TOPICS}) AS parents,
  (SELECT count(DISTINCT topic_id) FROM {EXERCISES} WHERE topic_id IN (SELECT topic_id FROM {TOPICS})) AS covered,
  {_KEY_COVER.format(k='topic_id', c=EXERCISES, p=TOPICS)} AS score""")
def coverage_score(spark, sf):
    return curriculum.coverage_score(base.topics(spark, sf), base.exercises(spark, sf), "topic_id")


@query("gap_report", f"""
SELECT 'topics' AS analysis, CAST(least(round(100.0 * t / least(g * s * 0.4, t + 15)), 100) AS INTEGER) AS score
FROM (SELECT (SELECT count(*) FROM {GRADES}) AS g, (SELECT count(*) FROM {SUBJECTS}) AS s, (SELECT count(*) FROM {TOPICS}) AS t)
UNION ALL SELECT 'exercises', {_KEY_COVER.format(k='topic_id', c=EXERCISES, p=TOPICS)}
UNION ALL SELECT 'bac_exams', {_KEY_COVER.format(k='track_id', c=EXAMS, p=TRACKS)}
UNION ALL SELECT 'lessons', CAST(round(100.0 * count(*) / (2 * count(*) + 5)) AS INTEGER) FROM orders
UNION ALL SELECT 'cycles', CAST(round(100.0 * count(*) / (2 * count(*) + 5)) AS INTEGER) FROM nation""")
def gap_report(spark, sf):
    return curriculum.gap_report(
        base.grades(spark, sf), base.subjects(spark, sf), base.topics(spark, sf), base.exercises(spark, sf), base.tracks(spark, sf),
        base.exams(spark, sf), {"lessons": table(spark, sf, "orders"), "cycles": base.cycles(spark, sf)},
    )


def _planner(spark, sf):
    return curriculum.planner_steps(
        base.grades(spark, sf), base.stored(base.mapped, spark, sf), base.subjects(spark, sf), base.topics(spark, sf),
        base.outlines(spark, sf), base.exercises(spark, sf), base.tracks(spark, sf),
    )


def _gap(child: str, n: str) -> str:
    return f"""(SELECT grade_id, count(*) AS m, string_agg(label, ' | ' ORDER BY topic_id) FILTER (WHERE r <= 5) AS f FROM (
  SELECT grade_id, topic_id, name || ': ' || title AS label, row_number() OVER (PARTITION BY grade_id ORDER BY topic_id) AS r
  FROM {TOPICS} JOIN {SUBJECTS} USING (subject_id) WHERE topic_id NOT IN (SELECT topic_id FROM {child})) GROUP BY 1)"""


def _children(child: str) -> str:
    return f"(SELECT grade_id, count(*) AS n FROM {child} JOIN {TOPICS} USING (topic_id) GROUP BY 1)"


@query("planner_steps", f"""
WITH b AS (SELECT g.grade_id, g.name, coalesce(l.n, 0) AS ns, coalesce(t.n, 0) AS nt, coalesce(t.d, 0) AS nd, coalesce(m2.m, 0) AS m2, m2.f AS f2,
    coalesce(o.n, 0) AS no, coalesce(e.n, 0) AS ne, coalesce(m3.m, 0) AS m3, m3.f AS f3, coalesce(m4.m, 0) AS m4, m4.f AS f4
  FROM {GRADES} g LEFT JOIN (SELECT grade_id, count(*) AS n FROM {MAPPED} GROUP BY 1) l USING (grade_id)
  LEFT JOIN (SELECT grade_id, count(*) AS n, count(DISTINCT subject_id) AS d FROM {TOPICS} GROUP BY 1) t USING (grade_id)
  LEFT JOIN (SELECT grade_id, count(*) AS m, string_agg(subject_id, ' | ' ORDER BY subject_id) FILTER (WHERE r <= 5) AS f FROM (
    SELECT m.*, row_number() OVER (PARTITION BY grade_id ORDER BY subject_id) AS r FROM {MAPPED} m
    WHERE NOT EXISTS (SELECT 1 FROM {TOPICS} t WHERE t.grade_id = m.grade_id AND t.subject_id = m.subject_id)) GROUP BY 1) m2 USING (grade_id)
  LEFT JOIN {_children(OUTLINES)} o USING (grade_id) LEFT JOIN {_children(EXERCISES)} e USING (grade_id)
  LEFT JOIN {_gap(OUTLINES, 'o')} m3 USING (grade_id) LEFT JOIN {_gap(EXERCISES, 'e')} m4 USING (grade_id))
SELECT grade_id, 1 AS step, 'Map Subjects to ' || name AS title, CASE WHEN ns = 0 THEN 'actionable' ELSE 'completed' END AS status,
  ns || ' Subjects Linked' AS metrics, CAST(NULL AS VARCHAR) AS first_missing FROM b
UNION ALL SELECT grade_id, 2, 'Build Syllabus Topics', CASE WHEN ns = 0 THEN 'locked' WHEN nt = 0 OR m2 > 0 THEN 'actionable' ELSE 'completed' END,
  CASE WHEN nt > 0 THEN nt || ' Topics across ' || nd || ' Subjects' ELSE '0 Topics' END, CASE WHEN nt > 0 THEN f2 END FROM b
UNION ALL SELECT grade_id, 3, 'Generate Lesson Outlines', CASE WHEN nt = 0 THEN 'locked' WHEN m3 > 0 THEN 'actionable' ELSE 'completed' END,
  CASE WHEN nt > 0 THEN no || ' Outlines across ' || (nt - m3) || '/' || nt || ' Topics' ELSE '0 Outlines' END, f3 FROM b
UNION ALL SELECT grade_id, 4, 'Populate Exercises', CASE WHEN nt = 0 THEN 'locked' WHEN m4 > 0 THEN 'actionable' ELSE 'completed' END,
  CASE WHEN nt > 0 THEN ne || ' Exercises across ' || (nt - m4) || '/' || nt || ' Topics' ELSE '0 Exercises' END, f4 FROM b
UNION ALL SELECT grade_id, 5, 'Configure Baccalaureate Tracks', 'completed', (SELECT count(*) FROM {TRACKS}) || ' Tracks Configured', NULL FROM b WHERE contains(lower(name), 'bac')""")
def planner_steps(spark, sf):
    return _planner(spark, sf)


@query("queue_size", "SELECT CAST(sum(CAST(trunc(o_totalprice * 200) AS BIGINT)) AS BIGINT) AS total_bytes, count(*) AS files FROM orders WHERE o_orderstatus = 'O'")
def queue_size(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'O'")
    return health.queue_size(o.select((F.col("o_totalprice") * 200).cast("long").alias("file_size")))


def _tests(spark, sf):
    """Every vector asks for its own label mates; nearest five decide."""
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.retrieval_test(q, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 5), e


_TESTS = f"""(SELECT query_id, string_agg(chunk_id, ',' ORDER BY r) AS ids, bool_or(chunk_id = query_id) AS passed,
    min(CASE WHEN chunk_id = query_id THEN r END) AS rank, round(max(score), 4) AS top_score, string_agg(CAST(round(score, 4) AS VARCHAR), ',' ORDER BY r) AS scores
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({s_cosine('q.embedding', 'c.embedding')}, 9) AS score FROM embeddings q, embeddings c))
  WHERE r <= 5 GROUP BY 1)"""


@query("retrieval_pass_rate", f"""
SELECT label, count(*) AS tests, count(*) FILTER (WHERE passed) AS passed, round(avg(CAST(passed AS INTEGER)), 4) AS pass_rate,
  round(avg(rank), 4) AS mean_rank, round(avg(top_score), 4) AS mean_top_score
FROM {_TESTS} JOIN embeddings ON vec_id = query_id GROUP BY 1""")
def retrieval_pass_rate(spark, sf):
    tests, e = _tests(spark, sf)
    return health.retrieval_pass_rate(tests.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id"), "label")


def _nodes(spark, sf):
    return curriculum.curriculum_nodes(
        base.curricula(spark, sf), base.cycles(spark, sf), base.grades(spark, sf), base.stored(base.mapped, spark, sf),
        base.stored(base.subjects, spark, sf), base.stored(base.sections, spark, sf), base.stored(base.tracks, spark, sf),
        base.stored(base.track_subjects, spark, sf),
    )


_TREE = f"""(WITH u AS (SELECT CAST(curriculum_id AS VARCHAR) AS path, NULL AS parent_path, 'curriculum' AS type, name, NULL AS grade, NULL AS subject FROM {CURRICULA}),
  c AS (SELECT curriculum_id || '/' || cycle_id AS path, CAST(curriculum_id AS VARCHAR) AS parent_path, cycle_id, name FROM {CYCLES}),
  g AS (SELECT c.path || '/' || grade_id AS path, c.path AS parent_path, grade_id, g.name, contains(lower(g.name), 'bac') AS bac FROM {GRADES} g JOIN c USING (cycle_id)),
  s AS (SELECT g.path || '/' || section_id AS path, g.path AS parent_path, section_id, s.name, grade_id FROM g, {SECTIONS} s WHERE bac),
  t AS (SELECT s.path || '/' || track_id AS path, s.path AS parent_path, track_id, t.name, grade_id FROM s JOIN {TRACKS} t USING (section_id)),
  n AS (SELECT * FROM u UNION ALL SELECT path, parent_path, 'cycle', name, NULL, NULL FROM c
    UNION ALL SELECT path, parent_path, 'grade', name, CAST(grade_id AS VARCHAR), NULL FROM g
    UNION ALL SELECT g.path || '/' || subject_id, g.path, 'subject', subject_id, CAST(grade_id AS VARCHAR), subject_id FROM g JOIN {MAPPED} USING (grade_id) WHERE NOT bac
    UNION ALL SELECT path, parent_path, 'section', name, CAST(grade_id AS VARCHAR), NULL FROM s
    UNION ALL SELECT path, parent_path, 'track', name, CAST(grade_id AS VARCHAR), NULL FROM t
    UNION ALL SELECT t.path || '/' || subject_id, t.path, 'subject', subject_id, CAST(grade_id AS VARCHAR), subject_id FROM t JOIN {TRACK_SUBJECTS} USING (track_id))
  SELECT n.*, coalesce(k.c, 0) AS n_children FROM n LEFT JOIN (SELECT parent_path AS p, count(*) AS c FROM n GROUP BY 1) k ON n.path = k.p)"""


@query("curriculum_tree", f"SELECT * FROM {_TREE}")
def curriculum_tree(spark, sf):
    return _nodes(spark, sf)


@query("node_tasks", f"""
WITH x AS (SELECT n.*, coalesce(p.k, 0) AS k, CASE WHEN n_children > 0 THEN 'completed' ELSE 'actionable' END AS done FROM {_TREE} n
  LEFT JOIN (SELECT CAST(grade_id AS VARCHAR) AS grade, subject_id AS subject, count(*) AS k FROM {TOPICS} GROUP BY 1, 2) p USING (grade, subject))
SELECT path, type, CASE type WHEN 'curriculum' THEN 'Define Cycles' WHEN 'cycle' THEN 'Define Grades' WHEN 'grade' THEN 'Map Subjects'
  WHEN 'section' THEN 'Define Tracks' WHEN 'track' THEN 'Map Track Subjects' END AS title, done AS status FROM x WHERE type <> 'subject'
UNION ALL SELECT path, type, 'Verify Sections & Tracks', done FROM x WHERE type = 'grade' AND contains(lower(name), 'bac')
UNION ALL SELECT path, type, 'Build Syllabus Topics', CASE WHEN k > 0 THEN 'completed' ELSE 'actionable' END FROM x WHERE type = 'subject'
UNION ALL SELECT path, type, 'Lesson Outlines & Exercises', 'actionable' FROM x WHERE type = 'subject' AND k > 0""")
def node_tasks(spark, sf):
    return curriculum.node_tasks(_nodes(spark, sf), base.topics(spark, sf))


@query("progress_eta", f"""
SELECT done, pending, CAST(round(100.0 * done / (done + pending)) AS INTEGER) AS percent, round(ms / done, 3) AS ms_per_row, round(ms / done * pending, 0) AS eta_ms
FROM (SELECT count(*) FILTER (WHERE embedding_status = 'done') AS done,
  count(*) FILTER (WHERE embedding IS NULL AND (embedding_status IS NULL OR embedding_status IN ('pending', 'failed'))) AS pending, 3600000.0::DOUBLE AS ms FROM {CHUNKS})""")
def progress_eta(spark, sf):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return health.progress_eta(base.chunks(spark, sf), start, F.lit("2024-01-01 01:00:00").cast("timestamp"))


@query("recent_chunks", f"SELECT chunk_id, created_at FROM {CHUNKS} ORDER BY created_at DESC, chunk_id LIMIT 500")
def recent_chunks(spark, sf):
    return curriculum.recent(base.chunks(spark, sf), "created_at", "chunk_id", 500).select("chunk_id", "created_at")


@query("recent_jobs", f"SELECT chunk_id AS job_id, ts AS created_at FROM {EVENTS} ORDER BY ts DESC, chunk_id LIMIT 200")
def recent_jobs(spark, sf):
    return curriculum.recent(base.event_log(spark, sf), "ts", "chunk_id", 200).select(F.col("chunk_id").alias("job_id"), F.col("ts").alias("created_at"))


@query("ordered_names", f"SELECT topic_id, title FROM {TOPICS} WHERE title <> '' ORDER BY title, topic_id LIMIT 2000")
def ordered_names(spark, sf):
    return curriculum.ordered_names(base.topics(spark, sf), "topic_id", "title", limit=2000)


@query("top_missing", f"""
SELECT analysis, item, title FROM (SELECT *, row_number() OVER (PARTITION BY analysis ORDER BY item) AS r FROM (
  SELECT 'exercises' AS analysis, CAST(topic_id AS VARCHAR) AS item, title FROM {TOPICS} WHERE topic_id NOT IN (SELECT topic_id FROM {EXERCISES})
  UNION ALL SELECT 'bac_exams', track_id, name FROM {TRACKS} WHERE track_id NOT IN (SELECT track_id FROM {EXAMS})
  UNION ALL SELECT 'grades', CAST(grade_id AS VARCHAR), name FROM {GRADES} WHERE grade_id NOT IN (SELECT grade_id FROM {TOPICS}))) WHERE r <= 4""")
def top_missing(spark, sf):
    def part(name, rows, key, title):
        return rows.select(F.lit(name).alias("analysis"), F.col(key).cast("string").alias("item"), F.col(title).alias("title"))

    gaps = part("exercises", resolve.missing_children(base.topics(spark, sf), base.exercises(spark, sf), "topic_id"), "topic_id", "title")
    gaps = gaps.unionByName(part("bac_exams", resolve.missing_children(base.tracks(spark, sf), base.exams(spark, sf), "track_id"), "track_id", "name"))
    gaps = gaps.unionByName(part("grades", resolve.missing_children(base.grades(spark, sf), base.topics(spark, sf), "grade_id"), "grade_id", "name"))
    return curriculum.top_missing(gaps, 4, F.col("item"))
