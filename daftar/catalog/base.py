"""Registry of the runnable queries and the bindings of the test tables.

Each binding exists twice: as a DataFrame and as the SQL subquery the check
engine runs, so that both sides start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions.text import JS_SPACES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, as_text: tuple[str, ...] = ()):
    """Register a query.  ``as_text`` columns (numbers and flags that may be null)
    are compared as strings, so that both engines show a null alike."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(spark, sf).withColumns({c: F.col(c).cast("string") for c in as_text})

        QUERIES[name] = run if as_text else fn
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in as_text)
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if as_text else sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL spellings of the text helpers ----------------------------------------

_JS = JS_SPACES
WS = r"[\s\x0B\x{FEFF}\p{Z}]"
AR = r"[\x{0600}-\x{06FF}]"


def s_trim(x: str) -> str:
    return f"trim({x}, '{_JS}')"


def s_re(x: str, pattern: str, to: str = "''", opts: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, '{opts}')"


def s_collapse(x: str) -> str:
    return s_trim(s_re(x, WS + "+", "' '"))


def s_clean(x: str) -> str:
    return s_trim(s_re(s_re(x, r"[ \t]+", "' '"), r"\n{3,}", "chr(10)||chr(10)"))


def s_norm(x: str) -> str:
    return s_clean(f"replace({x}, chr(13), '')")


def s_cosine(a: str, b: str) -> str:
    a, b = f"{a}::DOUBLE[]", f"{b}::DOUBLE[]"
    return f"list_dot_product({a},{b})/(sqrt(list_dot_product({a},{a}))*sqrt(list_dot_product({b},{b})))"


# --- documents as pages and chunks ----------------------------------------------

def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), "text", F.col("lang").alias("language"), F.col("source").alias("file_group")
    )


def pages(spark, sf) -> DataFrame:
    from daftar.sources.pages import page_scan

    return page_scan(docs(spark, sf), separator="\n")


def stored_pages(spark, sf) -> DataFrame:
    """The pages with low-text marks, as a written table."""
    from daftar.session import durable
    from daftar.sources.pages import ocr_mark

    return ocr_mark(durable(pages(spark, sf), "pages"))


PAGES = f"""(
  SELECT document_id, page_number, text, CAST(length(text) AS INTEGER) AS extracted_text_length,
         length(text) < 40 AS low_text, false AS ocr_detected
  FROM (SELECT doc_id AS document_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS page_number,
               {s_collapse('unnest(p)')} AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""


def chunks(spark, sf) -> DataFrame:
    """One chunk per document, with the states the maintenance operators look for."""
    d, l, e = table(spark, sf, "documents"), table(spark, sf, "labels"), table(spark, sf, "embeddings")
    q, tox, lang = F.col("quality"), F.col("toxic"), F.col("lang")
    joined = d.join(l, "doc_id", "left").join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars"))
    return joined.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.col("text").alias("content"),
        lang.alias("language"),
        "embedding",
        F.when(q.isNull(), None).when(F.col("embedding").isNotNull() & (tox == 0), "done")
        .when(q == 0, "failed").when(tox == 1, "processing").otherwise("pending").alias("embedding_status"),
        F.when(lang != "de", F.col("source")).alias("source_id"),
        F.when(q.isNotNull(), F.md5("text")).alias("content_hash"),
        F.when((q == 1) & (tox == 0), "clean").when(q == 1, "needs_review").when(q == 0, "rejected")
        .otherwise("auto_repaired").alias("repair_status"),
        F.coalesce(q != 0, F.lit(True)).alias("is_active"),
        F.round(F.least(F.col("n_chars"), F.lit(1000)) / 1000.0, 3).alias("quality_score"),
        at.alias("created_at"),
        F.when(lang != "es", at).alias("updated_at"),
        F.when(lang != "es", F.col("n_chars").cast("int")).alias("chunk_index"),
        F.when(lang == "en", F.col("text")).alias("original_content"),
        F.when(tox == 1, at).alias("embedding_claimed_at"),
        F.map_filter(
            F.create_map(
                F.lit("filename"), F.concat("source", F.lit(".pdf")),
                F.lit("grade"), F.when(lang == "en", "Tronc Commun").when(lang == "fr", "null"),
                F.lit("subject"), F.when(q == 1, "English").when(q == 0, "null"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("metadata"),
    )


CHUNKS = """(
  SELECT d.doc_id AS chunk_id, d.source AS document_id, d.text AS content, d.lang AS language, e.embedding,
    CASE WHEN l.quality IS NULL THEN NULL WHEN e.embedding IS NOT NULL AND l.toxic = 0 THEN 'done'
         WHEN l.quality = 0 THEN 'failed' WHEN l.toxic = 1 THEN 'processing' ELSE 'pending' END AS embedding_status,
    CASE WHEN d.lang <> 'de' THEN d.source END AS source_id,
    CASE WHEN l.quality IS NOT NULL THEN md5(d.text) END AS content_hash,
    CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'clean' WHEN l.quality = 1 THEN 'needs_review'
         WHEN l.quality = 0 THEN 'rejected' ELSE 'auto_repaired' END AS repair_status,
    coalesce(l.quality <> 0, true) AS is_active,
    round(least(d.n_chars, 1000) / 1000.0, 3) AS quality_score,
    TIMESTAMP '2024-01-01' + to_seconds(d.n_chars) AS created_at,
    CASE WHEN d.lang <> 'es' THEN TIMESTAMP '2024-01-01' + to_seconds(d.n_chars) END AS updated_at,
    CASE WHEN d.lang <> 'es' THEN CAST(d.n_chars AS INTEGER) END AS chunk_index,
    CASE WHEN d.lang = 'en' THEN d.text END AS original_content,
    CASE WHEN l.toxic = 1 THEN TIMESTAMP '2024-01-01' + to_seconds(d.n_chars) END AS embedding_claimed_at,
    d.source || '.pdf' AS md_filename,
    CASE d.lang WHEN 'en' THEN 'Tronc Commun' WHEN 'fr' THEN 'null' END AS md_grade,
    CASE l.quality WHEN 1 THEN 'English' WHEN 0 THEN 'null' END AS md_subject
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


# --- events as the state log of jobs and chunks -----------------------------------

def event_log(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "pending").when(kind == "click", "processing")
        .when(kind == "purchase", "done").when(kind == "error", "failed")
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("chunk_id"), F.col("user_id").alias("document_id"), F.col("ts").cast("timestamp").alias("ts"),
        status.alias("embedding_status"), "value", "props",
    )


EVENTS = """(
  SELECT event_id AS chunk_id, user_id AS document_id, ts, value, props,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done'
                    WHEN 'error' THEN 'failed' END AS embedding_status
  FROM events)"""


# --- the star schema as curriculum tables -------------------------------------------

def curricula(spark, sf):
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("curriculum_id"), F.col("r_name").alias("name"))


def cycles(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("cycle_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("curriculum_id")
    )


def grades(spark, sf):
    bac = F.when(F.col("s_nationkey") < 5, F.concat(F.lit("Bac "), "s_name")).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("grade_id"), bac.alias("name"), F.col("s_nationkey").alias("cycle_id")
    )


def subjects(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("subject_id"), F.col("p_brand").alias("name")).distinct()


def topics(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("subject_id"),
        F.col("p_size").cast("long").alias("grade_id"),
    )


def mapped(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .select(F.col("l_suppkey").alias("grade_id"), F.col("p_brand").alias("subject_id"))
        .distinct()
    )


# Children of topics come from tables whose ids cover only a part of the part keys,
# so that gaps are real and no filter is needed.
def exercises(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("topic_id"))


def outlines(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("topic_id"))


def sections(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("section_id"), F.col("c_mktsegment").alias("name")).distinct()


def _orders_customers(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).withColumn("track_id", F.concat_ws(":", "c_mktsegment", "o_orderpriority"))


def tracks(spark, sf):
    return _orders_customers(spark, sf).select("track_id", F.col("c_mktsegment").alias("section_id"), F.col("o_orderpriority").alias("name")).distinct()


def exams(spark, sf):
    """One exam per nation, for the track of its largest order; tracks that no nation picks have none."""
    largest = F.max_by("track_id", F.struct("o_totalprice", "o_orderkey")).alias("track_id")
    return _orders_customers(spark, sf).groupBy("c_nationkey").agg(largest).select("track_id")


def track_subjects(spark, sf):
    oc = _orders_customers(spark, sf).select("o_orderkey", "track_id")
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return (
        oc.join(line, oc.o_orderkey == line.l_orderkey).join(part, line.l_partkey == part.p_partkey)
        .select("track_id", F.col("p_brand").alias("subject_id")).distinct()
    )


def stored(binding, spark, sf) -> DataFrame:
    """A curriculum table derived from the fact tables, written once for many uses."""
    from daftar.session import durable

    return durable(binding(spark, sf), "dimension")


CURRICULA = "(SELECT r_regionkey AS curriculum_id, r_name AS name FROM region)"
CYCLES = "(SELECT n_nationkey AS cycle_id, n_name AS name, n_regionkey AS curriculum_id FROM nation)"
GRADES = "(SELECT s_suppkey AS grade_id, CASE WHEN s_nationkey < 5 THEN 'Bac ' || s_name ELSE s_name END AS name, s_nationkey AS cycle_id FROM supplier)"
SUBJECTS = "(SELECT DISTINCT p_brand AS subject_id, p_brand AS name FROM part)"
TOPICS = "(SELECT p_partkey AS topic_id, p_name AS title, p_brand AS subject_id, CAST(p_size AS BIGINT) AS grade_id FROM part)"
MAPPED = "(SELECT DISTINCT l_suppkey AS grade_id, p_brand AS subject_id FROM lineitem JOIN part ON l_partkey = p_partkey)"
EXERCISES = "(SELECT doc_id AS topic_id FROM labels)"
OUTLINES = "(SELECT o_custkey AS topic_id FROM orders)"
SECTIONS = "(SELECT DISTINCT c_mktsegment AS section_id, c_mktsegment AS name FROM customer)"
_OC = "(SELECT *, c_mktsegment || ':' || o_orderpriority AS track_id FROM orders JOIN customer ON o_custkey = c_custkey)"
TRACKS = f"(SELECT DISTINCT track_id, c_mktsegment AS section_id, o_orderpriority AS name FROM {_OC})"
EXAMS = f"(SELECT arg_max(track_id, (o_totalprice, o_orderkey)) AS track_id FROM {_OC} GROUP BY c_nationkey)"
TRACK_SUBJECTS = f"""(SELECT DISTINCT track_id, p_brand AS subject_id FROM {_OC}
  JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"""


# --- file names derived from the part table --------------------------------------------

def filenames(spark, sf) -> DataFrame:
    kind = F.col("p_type")
    word = (
        F.when(kind == "ECONOMY", "exercices").when(kind == "SMALL", "controle").when(kind == "STANDARD", "cours")
        .when(kind == "LARGE", "corrections").when(kind == "PROMO", "résumés").otherwise("document")
    )
    grade = (
        F.when(F.col("p_size") <= 10, "1ac").when(F.col("p_size") <= 20, "2eme année collège")
        .when(F.col("p_size") <= 30, "3ac").when(F.col("p_size") <= 40, "6eme primaire").otherwise("niveau")
    )
    name = F.concat_ws("-", word, F.replace("p_name", F.lit(" "), F.lit("_")), grade, F.concat(F.lit("version "), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.concat(name, F.lit(".pdf")).alias("filename"))


FILENAMES = """(
  SELECT p_partkey AS file_id, concat_ws('-',
    CASE p_type WHEN 'ECONOMY' THEN 'exercices' WHEN 'SMALL' THEN 'controle' WHEN 'STANDARD' THEN 'cours'
                WHEN 'LARGE' THEN 'corrections' WHEN 'PROMO' THEN 'résumés' ELSE 'document' END,
    replace(p_name, ' ', '_'),
    CASE WHEN p_size <= 10 THEN '1ac' WHEN p_size <= 20 THEN '2eme année collège' WHEN p_size <= 30 THEN '3ac'
         WHEN p_size <= 40 THEN '6eme primaire' ELSE 'niveau' END,
    'version ' || p_size) || '.pdf' AS filename
  FROM part)"""
