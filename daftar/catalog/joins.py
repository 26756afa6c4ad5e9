"""Joins (C) and set operations (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.catalog import base
from daftar.catalog.base import (
    CHUNKS, CURRICULA, CYCLES, EVENTS, EXERCISES, FILENAMES, GRADES, MAPPED, SECTIONS, SUBJECTS, TOPICS, TRACKS,
    query, s_cosine, s_re, s_trim, table,
)
from daftar.functions import names
from daftar.operators import aliases, curriculum, dedup, health, resolve, retrieval, vector_index
from daftar.session import scratch_path
from daftar.sources import hash_index


def _token_sql(x: str) -> str:
    return s_trim(s_re(f"strip_accents(lower({x}))", r"[^a-z0-9\x{0600}-\x{06FF}]+", "' '"))


def _part_aliases(spark, sf):
    """Spelling dictionary out of the data: each product name stands for the first brand that uses it."""
    part = table(spark, sf, "part")
    return part.select(
        F.lit("subject").alias("kind"), F.col("p_brand").alias("canonical"), F.col("p_name").alias("variant"),
        (-F.col("p_partkey")).cast("int").alias("ord"),
    )


_ALIASES = "(SELECT p_name AS token, min_by(p_brand, p_partkey) AS canonical, max(p_partkey) AS ord FROM part GROUP BY p_name)"


@query("alias_join", f"""
SELECT f.p_partkey, a.canonical FROM part f LEFT JOIN {_ALIASES} a ON {_token_sql("upper(replace(f.p_name, ' ', '__'))")} = a.token""")
def alias_join(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit("__"))).alias("w"))
    return aliases.alias_join(rows, aliases.alias_index(_part_aliases(spark, sf)), "w", "subject", "canonical").drop("w")


@query("alias_ngram_join", f"""
WITH f AS (SELECT file_id, list_filter(string_split(regexp_replace(strip_accents(lower(regexp_replace(filename, '\\.[^.]*$', ''))), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), lambda p: p <> '') AS parts FROM {FILENAMES}),
g AS (SELECT file_id, n, i, array_to_string(list_slice(parts, i, i + n - 1), ' ') AS phrase
  FROM f, (VALUES (3), (2), (1)) v(n), range(1, 20) r(i) WHERE i + n - 1 <= len(parts)),
h AS (SELECT file_id, arg_min(canonical, row(3 - n, i)) AS canonical FROM g JOIN {_ALIASES} a ON a.token = phrase GROUP BY file_id)
SELECT file_id, canonical FROM f LEFT JOIN h USING (file_id)""")
def alias_ngram_join(spark, sf):
    rows = base.filenames(spark, sf).select("file_id", names.name_parts(F.col("filename")).alias("parts"))
    index = aliases.alias_index(_part_aliases(spark, sf))
    return aliases.alias_ngram_join(rows, index, "file_id", "parts", "subject", "canonical").drop("parts")


@query("alias_fuzzy_join", f"""
WITH w AS (SELECT DISTINCT word FROM (SELECT p_partkey, lower(replace(p_name, 'e', '')) AS word FROM part) WHERE length(word) >= 3),
b AS (SELECT word, arg_min(canonical, row(levenshtein(word, token), -a.ord)) AS canonical
  FROM w JOIN (SELECT p_name AS token, min_by(p_brand, p_partkey) AS canonical, max(p_partkey) AS ord FROM part GROUP BY p_name) a
    ON levenshtein(word, token) <= 2 GROUP BY word)
SELECT p_partkey, canonical FROM part LEFT JOIN b ON lower(replace(p_name, 'e', '')) = word""")
def alias_fuzzy_join(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit("e"), F.lit(""))).alias("w"))
    index = aliases.alias_index(_part_aliases(spark, sf))
    return aliases.alias_fuzzy_join(rows, index, "w", "subject", "canonical").drop("w")


@query("resolve_ancestors", f"""
WITH g AS (SELECT lower(name) AS n, min(grade_id) AS grade_id, min(cycle_id) AS cycle_id FROM {GRADES} GROUP BY 1 HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, l_partkey, g.grade_id, g.cycle_id, c.curriculum_id
FROM lineitem LEFT JOIN g ON g.n = 'supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') LEFT JOIN {CYCLES} c USING (cycle_id)""", as_text=("grade_id", "cycle_id", "curriculum_id"))
def resolve_ancestors(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("grade_name"),
    )
    out = resolve.resolve_ancestors(lines, base.grades(spark, sf), base.cycles(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "grade_id", "cycle_id", "curriculum_id")


def _asks(spark, sf):
    """One request per order: a topic hint, and a grade for part of them."""
    o = table(spark, sf, "orders")
    hint = F.element_at(F.array(*[F.lit(w) for w in ("ring", "red_gear", "old-plate", "zzz")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(
        "o_orderkey", hint.alias("topic_hint"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 60).alias("grade_id"),
        F.concat(F.lit("BRAND#"), (F.col("o_custkey") % 30).cast("string")).alias("subject_hint"),
    )


_ASKS = """(SELECT o_orderkey, ['ring', 'red_gear', 'old-plate', 'zzz'][CAST(o_custkey % 4 + 1 AS INTEGER)] AS topic_hint,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 60 END AS grade_id, 'brand#' || (o_custkey % 30) AS subject_hint FROM orders)"""
_TOPIC_HIT = f"""(SELECT a.topic_hint, a.grade_id, min(row(t.topic_id, t.subject_id)) AS hit
  FROM (SELECT DISTINCT topic_hint, grade_id FROM {_ASKS}) a
  JOIN {TOPICS} t ON contains(lower(t.title), regexp_replace(lower(a.topic_hint), '[_-]+', ' ', 'g')) AND (a.grade_id IS NULL OR a.grade_id = t.grade_id)
  GROUP BY ALL)"""


@query("resolve_topic", f"""
SELECT a.o_orderkey, a.grade_id, hit[1] AS topic_id, hit[2] AS topic_subject_id FROM {_ASKS} a
LEFT JOIN {_TOPIC_HIT} h ON a.topic_hint = h.topic_hint AND a.grade_id IS NOT DISTINCT FROM h.grade_id""", as_text=("grade_id", "topic_id"))
def resolve_topic(spark, sf):
    return resolve.resolve_topic(_asks(spark, sf), base.topics(spark, sf)).drop("topic_hint", "subject_hint")


@query("resolve_fallback", f"""
WITH a AS (SELECT a.*, hit[1] AS t, hit[2] AS s FROM {_ASKS} a
  LEFT JOIN {_TOPIC_HIT} h ON a.topic_hint = h.topic_hint AND a.grade_id IS NOT DISTINCT FROM h.grade_id),
b AS (SELECT a.*, coalesce(s, CASE WHEN t IS NULL THEN s.subject_id END) AS subject_id FROM a LEFT JOIN {SUBJECTS} s ON lower(s.name) = a.subject_hint),
g AS (SELECT grade_id, subject_id, min(topic_id) AS g FROM {TOPICS} GROUP BY ALL)
SELECT o_orderkey, b.grade_id, b.subject_id, coalesce(t, g) AS topic_id FROM b LEFT JOIN g USING (grade_id, subject_id)""", as_text=("grade_id", "topic_id"))
def resolve_fallback(spark, sf):
    found = resolve.resolve_topic(_asks(spark, sf), base.topics(spark, sf))
    out = resolve.resolve_fallback(found, base.subjects(spark, sf), base.topics(spark, sf))
    return out.select("o_orderkey", "grade_id", "subject_id", "topic_id")


@query("resolve_metadata_refs", f"""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 50 END AS grade_id,
    'supplier#' || lpad(CAST(o_custkey % 150 AS VARCHAR), 9, '0') AS grade_name, 'brand#' || (o_custkey % 30) AS subject_name,
    CASE WHEN o_custkey % 2 = 0 THEN 'RED RING' ELSE 'old rod' END AS topic_title FROM orders),
y AS (SELECT x.o_orderkey, x.topic_title, coalesce(x.grade_id, g.grade_id) AS grade_id, s.subject_id FROM x
  LEFT JOIN {GRADES} g ON lower(g.name) = x.grade_name LEFT JOIN {SUBJECTS} s ON lower(s.name) = x.subject_name),
t AS (SELECT grade_id, subject_id, lower(title) AS title, min(topic_id) AS topic_id FROM {TOPICS} GROUP BY ALL HAVING count(*) = 1)
SELECT y.o_orderkey, y.grade_id, y.subject_id, t.topic_id FROM y
LEFT JOIN t ON y.grade_id = t.grade_id AND y.subject_id = t.subject_id AND lower(y.topic_title) = t.title""", as_text=("grade_id", "topic_id"))
def resolve_metadata_refs(spark, sf):
    key = F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", key % 50).alias("grade_id"),
        F.lit(None).cast("string").alias("subject_id"), F.lit(None).cast("long").alias("topic_id"),
        F.concat(F.lit("Supplier#"), F.lpad((key % 150).cast("string"), 9, "0")).alias("grade_name"),
        F.concat(F.lit("brand#"), (key % 30).cast("string")).alias("subject_name"),
        F.when(key % 2 == 0, "RED RING").otherwise("old rod").alias("topic_title"),
    )
    out = resolve.resolve_metadata_refs(rows, base.grades(spark, sf), base.subjects(spark, sf), base.topics(spark, sf))
    return out.select("o_orderkey", "grade_id", "subject_id", "topic_id")


_SLUG = "trim(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"


@query("slug_match_join", f"""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Supplier#' || lpad(CAST(o_custkey % 150 AS VARCHAR), 9, '0') WHEN o_orderstatus = 'O' THEN 'Other' END AS grade_label,
    CASE WHEN o_orderstatus = 'F' THEN 'none' WHEN o_orderstatus = 'O' THEN lpad(CAST(o_custkey % 150 AS VARCHAR), 4, '0') END AS grade_slug,
    ['Red Ring!', 'ring', 'the old plate reader', 'zzz'][CAST(o_custkey % 4 + 1 AS INTEGER)] AS topic_title,
    CASE WHEN o_orderstatus = 'P' THEN 'low' ELSE 'medium' END AS confidence FROM orders),
g AS (SELECT a.grade_slug, a.grade_label, min(row(g.grade_id, g.name)) AS h FROM (SELECT DISTINCT grade_slug, grade_label FROM x WHERE grade_label IS NOT NULL) a
  JOIN {GRADES} g ON {_SLUG.format('g.name')} = {_SLUG.format('a.grade_label')} OR contains({_SLUG.format('g.name')}, {_SLUG.format('a.grade_slug')}) GROUP BY ALL),
y AS (SELECT x.o_orderkey, x.confidence, x.topic_title, h[1] AS grade_id, coalesce(h[2], x.grade_label) AS resolved_grade
  FROM x LEFT JOIN g ON x.grade_slug = g.grade_slug AND x.grade_label = g.grade_label),
t AS (SELECT a.topic_title, a.grade_id, min(row(t.topic_id, t.subject_id)) AS h FROM (SELECT DISTINCT topic_title, grade_id FROM y) a
  JOIN {TOPICS} t ON (a.grade_id IS NULL OR t.grade_id = a.grade_id) AND
    (contains({_SLUG.format('t.title')}, {_SLUG.format('a.topic_title')}) OR contains({_SLUG.format('a.topic_title')}, {_SLUG.format('t.title')})) GROUP BY ALL)
SELECT y.o_orderkey, y.grade_id, resolved_grade, h[1] AS topic_id, h[2] AS subject_label,
  CASE WHEN h[2] IS NOT NULL AND confidence = 'medium' THEN 'high' ELSE confidence END AS confidence
FROM y LEFT JOIN t ON y.topic_title = t.topic_title AND y.grade_id IS NOT DISTINCT FROM t.grade_id""", as_text=("grade_id", "topic_id"))
def slug_match_join(spark, sf):
    key, st = F.col("o_custkey"), F.col("o_orderstatus")
    titles = F.array(*[F.lit(w) for w in ("Red Ring!", "ring", "the old plate reader", "zzz")])
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(st == "F", F.concat(F.lit("Supplier#"), F.lpad((key % 150).cast("string"), 9, "0"))).when(st == "O", "Other").alias("grade_label"),
        F.when(st == "F", "none").when(st == "O", F.lpad((key % 150).cast("string"), 4, "0")).alias("grade_slug"),
        F.element_at(titles, (key % 4 + 1).cast("int")).alias("topic_title"),
        F.when(st == "P", "low").otherwise("medium").alias("confidence"),
    )
    out = resolve.slug_match_join(rows, base.grades(spark, sf), base.topics(spark, sf), base.subjects(spark, sf))
    return out.select("o_orderkey", "grade_id", "resolved_grade", "topic_id", "subject_label", "confidence")


@query("chunk_listing", """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority AS filename, s_name AS grade, p_brand AS subject, p_name AS topic
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey""")
def chunk_listing(spark, sf):
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("subject_id")), "l_partkey", "left")
    rows = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("grade_id"),
        "subject_id", F.col("l_partkey").alias("topic_id"),
    )
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("filename"))
    grades = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grade_id"), F.col("s_name").alias("name"))
    out = resolve.chunk_listing(rows, docs, grades, base.subjects(spark, sf), base.topics(spark, sf))
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("document.filename"), F.col("grade.name").alias("grade"),
        F.col("subject.name").alias("subject"), F.col("topic.title").alias("topic"),
    )


def _jobs(spark, sf):
    log = base.event_log(spark, sf)
    return log.select(
        F.col("chunk_id").alias("job_id"), "document_id", F.coalesce("embedding_status", F.lit("completed")).alias("status"),
        F.col("ts").alias("created_at"), F.lit(1).alias("retry_count"), F.lit("x").alias("error_message"), F.col("ts").alias("completed_at"),
    )


def _job_docs(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"))


@query("job_listing", f"""
SELECT e.chunk_id AS job_id, document_id, coalesce(embedding_status, 'completed') AS status, c_name AS filename
FROM {EVENTS} e LEFT JOIN customer ON document_id = c_custkey""")
def job_listing(spark, sf):
    out = resolve.job_listing(_jobs(spark, sf), _job_docs(spark, sf))
    return out.select("job_id", "document_id", "status", F.col("document.filename"))


@query("job_retry", f"""
SELECT e.chunk_id AS job_id, 'pending' AS status, 2 AS retry_count, CAST(NULL AS VARCHAR) AS error_message, 'Retry requested.' AS last_log
FROM {EVENTS} e WHERE document_id IN (SELECT c_custkey FROM customer)""")
def job_retry(spark, sf):
    jobs = _jobs(spark, sf).withColumn("logs", F.lit(None).cast("array<struct<message:string,level:string,at:timestamp>>"))
    out = resolve.job_retry(jobs, _job_docs(spark, sf), F.col("created_at"))
    return out.select("job_id", "status", "retry_count", "error_message", F.col("logs")[0]["message"].alias("last_log"))


@query("document_with_jobs", f"""
WITH j AS (SELECT chunk_id AS job_id, document_id, coalesce(embedding_status, 'completed') AS status, ts FROM {EVENTS}),
f AS (SELECT document_id, arg_min(status, row(ts, job_id)) AS shown_status, count(*) AS n_jobs FROM j GROUP BY 1)
SELECT c_custkey AS document_id, c_name AS filename, coalesce(shown_status, 'metadata_required') AS shown_status,
  coalesce(n_jobs, 0) AS n_jobs, job_id, status AS job_status
FROM customer LEFT JOIN f ON c_custkey = f.document_id LEFT JOIN j ON c_custkey = j.document_id""", as_text=("job_id",))
def document_with_jobs(spark, sf):
    return resolve.document_with_jobs(_job_docs(spark, sf), _jobs(spark, sf))


@query("already_ingested", f"SELECT c_custkey, c_name AS filename FROM customer WHERE 'src' || c_custkey || '.pdf' IN (SELECT md_filename FROM {CHUNKS})")
def already_ingested(spark, sf):
    files = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("shown"), F.concat(F.lit("src"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("filename"))
    return resolve.already_ingested(files, base.chunks(spark, sf)).select("c_custkey", F.col("shown").alias("filename"))


_UNSTORED = """
SELECT chunk_id, content_hash FROM (
  SELECT doc_id AS chunk_id, md5(text) AS content_hash, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents)
WHERE r = 1 AND content_hash NOT IN (SELECT md5(text) FROM documents WHERE lang = 'de')"""


def _hashed(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("content_hash"), "lang")


@query("dedup_against_store", _UNSTORED)
def dedup_against_store(spark, sf):
    d = _hashed(spark, sf)
    return dedup.dedup_against_store(d, d.filter("lang = 'de'")).select("chunk_id", "content_hash")


@query("dedup_against_index", _UNSTORED)
def dedup_against_index(spark, sf):
    """The same rows from the stored hash index, filled in three appends, one of them repeated."""
    d, path = _hashed(spark, sf), scratch_path(spark, "hash-index")
    de = d.filter("lang = 'de'")
    hash_index.create(de.filter("chunk_id % 3 = 0"), path)
    for part in (1, 2, 2):
        hash_index.append(de.filter(f"chunk_id % 3 = {part}"), path, batch=f"part-{part}")
    return hash_index.unseen(d, path).select("chunk_id", "content_hash")


@query("coverage_anti_join", f"SELECT topic_id, title FROM {TOPICS} WHERE topic_id NOT IN (SELECT topic_id FROM {EXERCISES})")
def coverage_anti_join(spark, sf):
    return resolve.missing_children(base.topics(spark, sf), base.exercises(spark, sf), "topic_id").select("topic_id", "title")


@query("missing_combinations", f"""
SELECT g.grade_id, s.subject_id FROM (SELECT DISTINCT grade_id FROM {GRADES}) g, {SUBJECTS} s
WHERE NOT EXISTS (SELECT 1 FROM {TOPICS} t WHERE t.grade_id = g.grade_id AND t.subject_id = s.subject_id)""")
def missing_combinations(spark, sf):
    return resolve.missing_combinations(base.grades(spark, sf), "grade_id", base.subjects(spark, sf), "subject_id", base.topics(spark, sf))


@query("bridge_join", f"""
SELECT g.grade_id, m.subject_id, coalesce(s.name, 'Unknown') AS child_name FROM {GRADES} g JOIN {MAPPED} m USING (grade_id)
LEFT JOIN {SUBJECTS} s ON m.subject_id = s.subject_id""")
def bridge_join(spark, sf):
    out = resolve.bridge_join(base.grades(spark, sf), "grade_id", base.mapped(spark, sf), base.subjects(spark, sf), "subject_id")
    return out.select("grade_id", "subject_id", "child_name")


@query("hierarchy_flatten", f"""
SELECT g.grade_id, g.name, coalesce(c.name, 'Unknown Cycle') AS cycle_name, coalesce(u.name, 'Unknown Curriculum') AS curriculum_name
FROM (SELECT p_partkey AS grade_id, p_name AS name, p_size AS cycle_id FROM part) g
LEFT JOIN {CYCLES} c ON g.cycle_id = c.cycle_id LEFT JOIN {CURRICULA} u ON c.curriculum_id = u.curriculum_id""")
def hierarchy_flatten(spark, sf):
    # Sizes go up to 50 and cycles to 24, so half the grades have an unknown cycle.
    grades = table(spark, sf, "part").select(F.col("p_partkey").alias("grade_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("cycle_id"))
    return resolve.hierarchy_flatten(grades, base.cycles(spark, sf), base.curricula(spark, sf))


@query("cosine_pairs", f"""
SELECT query_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({s_cosine('q.embedding', 'c.embedding')}, 9) AS score
    FROM embeddings q JOIN embeddings c ON q.label = c.label))
WHERE rank <= 10""")
def cosine_pairs(spark, sf):
    """Ten nearest chunks of every vector within its own document (the label)."""
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    c = e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    out = retrieval.cosine_topk(q, c, 10, scope="label")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("ann_pairs")
def ann_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.ann_pairs(q, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 5, dim=64)


@query("ann_recall", "SELECT 5 * count(*) AS neighbours, true AS enough FROM embeddings")
def ann_recall(spark, sf):
    """Whether the approximate search finds nine of ten exact neighbours, and all rows it owes."""
    e = table(spark, sf, "embeddings")
    q, c = e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    out = retrieval.ann_recall(retrieval.ann_pairs(q, c, 5, dim=64), retrieval.cosine_topk(q, c, 5))
    return out.select("neighbours", (F.col("recall") >= 0.9).alias("enough"))


def _indexed(spark, sf):
    """Four fifths of the vectors built into an index, the others added to it; everyone's queries."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    path = scratch_path(spark, "vector-index")
    vector_index.build(e.filter("chunk_id % 5 <> 0"), path, dim=64, k=5)
    vector_index.add(spark, path, e.filter("chunk_id % 5 = 0"))
    queries = e.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return e, queries, vector_index.search(queries, vector_index.load(spark, path), 5)


@query("ann_index_pairs")
def ann_index_pairs(spark, sf):
    return _indexed(spark, sf)[2]


@query("ann_index_recall", "SELECT 5 * count(*) AS neighbours, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def ann_index_recall(spark, sf):
    """Whether the probed cells hold nine of ten exact neighbours (queries: ids divisible by 20, against all rows)."""
    e, queries, found = _indexed(spark, sf)
    return retrieval.ann_recall(found, retrieval.cosine_topk(queries, e, 5)).select("neighbours", (F.col("recall") >= 0.9).alias("enough"))


@query("chunk_detail", """
SELECT c_custkey AS chunk_id, kind, place, payload FROM customer LEFT JOIN (
  SELECT o_custkey AS k, 'version' AS kind, o_orderkey AS place, o_orderpriority AS payload FROM orders
  UNION ALL SELECT user_id, 'embedding', epoch_us(ts), event_type FROM events) ON c_custkey = k""", as_text=("place",))
def chunk_detail(spark, sf):
    chunks = table(spark, sf, "customer").select(F.col("c_custkey").alias("chunk_id"))
    versions = table(spark, sf, "orders").select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").alias("version_index"), F.col("o_orderpriority").alias("content"))
    vectors = table(spark, sf, "events").select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("model"))
    return resolve.chunk_detail(chunks, versions, vectors)


@query("hash_union", "SELECT md5(text) AS content_hash FROM documents UNION SELECT md5(text) FROM conversations UNION SELECT md5(text) FROM benchmark")
def hash_union(spark, sf):
    def hashes(name):
        return table(spark, sf, name).select(F.md5("text").alias("content_hash"))

    return dedup.hash_union(dedup.hash_union(hashes("documents"), hashes("conversations")), hashes("benchmark"))


@query("subject_difference", f"SELECT grade_id, subject_id FROM {MAPPED} m WHERE NOT EXISTS (SELECT 1 FROM {TOPICS} t WHERE t.grade_id = m.grade_id AND t.subject_id = m.subject_id)")
def subject_difference(spark, sf):
    return curriculum.subject_difference(base.mapped(spark, sf), base.topics(spark, sf))


def _inventory(spark, sf):
    return health.table_inventory({
        "bac_sections": base.sections(spark, sf), "bac_tracks": base.tracks(spark, sf), "chunks": base.chunks(spark, sf),
        "topics": base.topics(spark, sf), "lessons": table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "quizzes": None,
    })


@query("table_inventory", f"""
SELECT table_name, row_count, missing, CASE WHEN missing THEN 'missing' WHEN row_count > 0 THEN 'populated' ELSE 'empty' END AS state FROM (
  SELECT 'bac_sections' AS table_name, count(*) AS row_count, false AS missing FROM {SECTIONS}
  UNION ALL SELECT 'bac_tracks', count(*), false FROM {TRACKS} UNION ALL SELECT 'chunks', count(*), false FROM documents
  UNION ALL SELECT 'topics', count(*), false FROM part UNION ALL SELECT 'lessons', count(*), false FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'quizzes', 0, true)""")
def table_inventory(spark, sf):
    return _inventory(spark, sf)


@query("inventory_todo", f"""
SELECT 't_vector_gap' AS id, 'Embed Existing Chunks' AS task, 'high' AS severity WHERE (SELECT count(*) FROM {CHUNKS} WHERE embedding IS NULL) > 0
UNION ALL SELECT 's-' || name, 'Add Tracks for ' || name, 'medium' FROM (SELECT * FROM {SECTIONS} UNION SELECT event_type, event_type FROM events)
  WHERE section_id NOT IN (SELECT section_id FROM {TRACKS})""")
def inventory_todo(spark, sf):
    # Event types are sections, too, and have no track.
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("section_id"), F.col("event_type").alias("name")).distinct()
    return health.inventory_todo(_inventory(spark, sf), base.chunks(spark, sf), base.sections(spark, sf).unionByName(kinds), base.tracks(spark, sf))
