"""Corpus operators: chunking, quality, model stages and whole plans (I)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from daftar.catalog import base
from daftar.catalog.base import CHUNKS, PAGES, WS, query, s_clean, s_collapse, s_cosine, s_norm, s_trim, table
from daftar.catalog.functions import SEGMENT, SPACED, SYMBOLS, TITLE, _TOPIC, _grade_sql
from daftar.functions import names
from daftar.functions.text import detect_title
from daftar.operators import aliases, chunking, dedup, edit, filters, models, quality, retrieval
from daftar.plans import cleanup, ingest, review
from daftar.session import durable


# --- chunking -----------------------------------------------------------------

_FIXED = f"""(SELECT doc_id, CAST(i AS INTEGER) AS window_index, {s_trim('substr(t, CAST(i * 1000 + 1 AS BIGINT), 1200)')} AS content
  FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - 1200) / 1000.0)) + 1 AS BIGINT))) AS i
        FROM (SELECT doc_id, {s_clean('text')} AS t FROM documents) WHERE length(t) > 0))"""


@query("chunk_fixed", f"SELECT * FROM {_FIXED} WHERE length(content) >= 100")
def chunk_fixed(spark, sf):
    return chunking.chunk_fixed(table(spark, sf, "documents"), "doc_id")


def _last(mark: str) -> str:
    """Absolute place of the last ``mark`` in the searched part ``w`` (0-based), else null."""
    back = f"reverse({mark})"
    return f"CASE WHEN instr(reverse(w), {back}) > 0 THEN f + length(w) - instr(reverse(w), {back}) - 1 END"


_CUT = f"""SELECT doc_id, t, n, s, CASE WHEN e0 >= n THEN n ELSE coalesce({_last('chr(10)||chr(10)')},
    greatest({_last("'. '")}, {_last("'! '")}, {_last("'? '")}, {_last("'؟ '")}) + 1, e0) END AS e, k
  FROM (SELECT *, substr(t, f + 1, e0 + 2 - f) AS w FROM (SELECT *, least(s + 1200, n) AS e0, s + 601 AS f FROM ({{0}})))"""
_WINDOWS = f"""(WITH RECURSIVE d AS (SELECT doc_id, {s_clean('text')} AS t FROM documents), x AS (
  {_CUT.format('SELECT doc_id, t, length(t) AS n, CAST(0 AS BIGINT) AS s, 0 AS k FROM d WHERE length(t) > 0')}
  UNION ALL {_CUT.format('SELECT doc_id, t, n, e - 200 AS s, k + 1 AS k FROM x WHERE e < n')})
  SELECT doc_id, s AS start, k, {s_trim('substr(t, s + 1, e - s)')} AS content FROM x)"""


@query("chunk_window", f"""
SELECT doc_id, CAST(start AS INTEGER) AS start, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index
FROM {_WINDOWS} WHERE length(content) >= 100""")
def chunk_window(spark, sf):
    return chunking.chunk_window(table(spark, sf, "documents").select("doc_id", "text"))


def _tail(end: str, start: str, back: int) -> str:
    """Place of the first non-blank among the last ``back`` characters of a span."""
    sub = f"substr(t, greatest({start}, {end} - {back}) + 1, {end} - greatest({start}, {end} - {back}))"
    return f"({end} - length(ltrim({sub}, ' ' || chr(10))))"


# Paragraphs; sentence runs of those over 1200 characters; all units on one canvas; packing; then cuts of what is too long.
_PACKED = f"""(WITH RECURSIVE par AS MATERIALIZED (
  SELECT doc_id, p, x FROM (SELECT doc_id, generate_subscripts(a, 1) AS p, {s_collapse('unnest(a)')} AS x FROM (
    SELECT doc_id, regexp_split_to_array({s_trim("regexp_replace(replace(text, chr(13), ''), '[ \t]+' || chr(10), chr(10), 'g')")}, '\n{WS}*\n') AS a FROM documents)) WHERE x <> ''),
sen AS MATERIALIZED (SELECT doc_id, p, i, x, CAST(sum(length(x) + 1) OVER (PARTITION BY doc_id, p ORDER BY i) AS BIGINT) - 1 AS stop FROM (
  SELECT doc_id, p, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (
    SELECT doc_id, p, string_split(regexp_replace(x, '([.!?;:؟]) ', '\\1' || chr(1), 'g'), chr(1)) AS a FROM par WHERE length(x) > 1200))),
run AS (
  SELECT doc_id, p, i, stop, CAST(0 AS BIGINT) AS s FROM sen WHERE i = 1
  UNION ALL
  SELECT sen.doc_id, sen.p, sen.i, sen.stop, CASE WHEN sen.stop - run.s > 1200 THEN run.stop + 1 ELSE run.s END
  FROM run JOIN sen ON sen.doc_id = run.doc_id AND sen.p = run.p AND sen.i = run.i + 1),
unit AS (
  SELECT doc_id, p, CAST(0 AS BIGINT) AS s, x FROM par WHERE length(x) <= 1200
  UNION ALL
  SELECT par.doc_id, par.p, g.s, substr(x, g.s + 1, g.e - g.s) FROM (SELECT doc_id, p, s, max(stop) AS e FROM run GROUP BY ALL) g JOIN par ON par.doc_id = g.doc_id AND par.p = g.p),
placed AS MATERIALIZED (SELECT *, ue - length(x) AS us FROM (
  SELECT doc_id, x, row_number() OVER w AS k, CAST(sum(length(x) + 2) OVER w AS BIGINT) - 2 AS ue FROM unit WINDOW w AS (PARTITION BY doc_id ORDER BY p, s))),
canvas AS MATERIALIZED (SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY k) AS t, max(k) AS units FROM placed GROUP BY doc_id),
pack AS (
  SELECT doc_id, t, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, CAST(NULL AS BIGINT) AS cs, CAST(NULL AS BIGINT) AS ce, CAST(NULL AS BIGINT) AS ls, CAST(NULL AS BIGINT) AS le FROM canvas
  UNION ALL
  SELECT doc_id, t, k, CASE WHEN ue - s1 > 1200 THEN ue ELSE s1 END, ue, CASE WHEN full_ THEN s END, CASE WHEN full_ THEN e END, CASE WHEN ue - s1 > 1200 THEN s1 END, CASE WHEN ue - s1 > 1200 THEN ue END FROM (
    SELECT *, CASE WHEN e = s THEN us WHEN NOT full_ THEN s WHEN ue - us > 1200 OR {_tail('e', 's', 200)} = e THEN us ELSE {_tail('e', 's', 200)} END AS s1 FROM (
      SELECT pack.doc_id, t, placed.k, us, ue, s, e, e > s AND ue - s > 1200 AS full_
      FROM pack JOIN placed ON placed.doc_id = pack.doc_id AND placed.k = pack.k + 1))),
long AS (
  SELECT doc_id, t, k, 1 AS j, ls AS s, le AS e, ls + 660 + length(regexp_extract(substr(t, ls + 661, 540), '^(?s:.*)[ \n]')) AS c FROM pack WHERE ls IS NOT NULL
  UNION ALL
  SELECT doc_id, t, k, j, s, e, s + 660 + length(regexp_extract(substr(t, s + 661, 540), '^(?s:.*)[ \n]')) FROM (
    SELECT doc_id, t, k, j + 1 AS j, {_tail('CASE WHEN c = s + 660 THEN s + 1200 ELSE c END', 's', 200)} AS s, e FROM long WHERE e - s > 1200)),
cut AS (
  SELECT doc_id, t, k, 0 AS j, cs AS s, ce AS e FROM pack WHERE cs IS NOT NULL
  UNION ALL SELECT doc_id, t, k, j, s, CASE WHEN e - s <= 1200 THEN e WHEN c = s + 660 THEN s + 1200 ELSE c END FROM long
  UNION ALL SELECT pack.doc_id, pack.t, pack.k + 1, 0, s, e FROM pack JOIN canvas ON canvas.doc_id = pack.doc_id AND pack.k = units WHERE e > s)
SELECT doc_id, k, j, trim(substr(t, s + 1, e - s), ' ' || chr(10)) AS content FROM cut)"""


@query("chunk_paragraph", f"""
SELECT doc_id, content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INTEGER) AS chunk_index
FROM {_PACKED} WHERE length(content) >= 100""")
def chunk_paragraph(spark, sf):
    return chunking.chunk_paragraph(table(spark, sf, "documents").select("doc_id", "text"))


def _classes(spark, sf):
    lang = F.col("lang")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(lang != "de", lang).alias("title"), lang.alias("language"),
        F.when(lang == "en", "Tronc Commun").alias("grade_name"), F.when(lang.isin("en", "fr"), "English").alias("subject_name"),
    )


_DRAFTS = f"""(WITH RECURSIVE p AS MATERIALIZED (SELECT document_id, page_number AS n, text AS b, low_text AS low, max(page_number) OVER (PARTITION BY document_id) AS last FROM {PAGES}),
f AS (
  SELECT document_id, 0 AS n, '' AS c, 1 AS s, false AS o, CAST(NULL AS VARCHAR) AS c1, 1 AS s1, false AS q1, CAST(NULL AS VARCHAR) AS c2, 1 AS s2, false AS q2 FROM (SELECT DISTINCT document_id FROM p)
  UNION ALL
  SELECT document_id, n, CASE WHEN done THEN '' ELSE cc END, ss, CASE WHEN done THEN false ELSE oo END, CASE WHEN over THEN c END, s, o, CASE WHEN done THEN cc END, ss, oo FROM (
    SELECT *, b <> '' AND (length(cc) >= 1200 OR low) AS done FROM (
      SELECT f.document_id, p.n, p.b, p.low, f.c, f.s, f.o, p.b <> '' AND f.c <> '' AND length(f.c) + 2 + length(p.b) > 2200 AS over,
        CASE WHEN p.b <> '' AND (f.c = '' OR length(f.c) + 2 + length(p.b) > 2200) THEN p.b WHEN f.c = '' THEN '[Page ' || p.n || ']'
             WHEN p.b = '' THEN f.c || chr(10) || chr(10) || '[Page ' || p.n || ']' ELSE f.c || chr(10) || chr(10) || p.b END AS cc,
        CASE WHEN f.c = '' OR (p.b <> '' AND length(f.c) + 2 + length(p.b) > 2200) THEN p.n ELSE f.s END AS ss,
        CASE WHEN p.b <> '' AND f.c <> '' AND length(f.c) + 2 + length(p.b) > 2200 THEN p.low ELSE f.o OR p.low END AS oo
      FROM f JOIN p ON p.document_id = f.document_id AND p.n = f.n + 1)))
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY n, k) - 1 AS INTEGER) AS chunk_index, content, page_start, page_end, ocr_detected FROM (
  SELECT document_id, n, 1 AS k, c1 AS content, s1 AS page_start, n AS page_end, q1 AS ocr_detected FROM f WHERE c1 IS NOT NULL
  UNION ALL SELECT document_id, n, 2, c2, s2, n, q2 FROM f WHERE c2 IS NOT NULL
  UNION ALL SELECT f.document_id, f.n, 3, c, s, f.n, o FROM f JOIN p ON p.document_id = f.document_id AND p.n = f.n WHERE f.n = p.last AND c <> ''))"""
_TITLED = f"""(SELECT x.*, {TITLE.format('line', 'fallback')} AS title, {SEGMENT.format('content')} AS segment_type FROM (
  SELECT a.*, lang AS language, CASE WHEN lang <> 'de' THEN lang END AS fallback, {s_trim('split_part(content, chr(10), 1)')} AS line, md5(content) AS content_hash
  FROM {_DRAFTS} a JOIN documents ON doc_id = document_id) x)"""


_PAGE_CHUNKS = f"SELECT document_id, chunk_index, content, page_start, page_end, ocr_detected, title, language, segment_type, content_hash FROM {_TITLED}"


@query("chunk_pages", _PAGE_CHUNKS)
def chunk_pages(spark, sf):
    out = chunking.chunk_pages(base.stored_pages(spark, sf), _classes(spark, sf))
    return out.drop("original_content", "document_title")


@query("chunk_pages_split", _PAGE_CHUNKS)
def chunk_pages_split(spark, sf):
    """The same chunks, every document over five pages folded in several tasks."""
    out = chunking.chunk_pages(base.stored_pages(spark, sf), _classes(spark, sf), giant_pages=5)
    return out.drop("original_content", "document_title")


# --- quality ---------------------------------------------------------------------

_PENALTY = quality.PENALTIES


def _scored_sql(src: str) -> str:
    """Scores for rows ``(id, content, title, ocr, g, s, t, dup)``."""
    n = f"length({s_trim('content')})"
    letters = r"length(regexp_replace(content, '[^a-zA-Z\x{0600}-\x{06FF}]+', '', 'g'))"
    noise = f"""(SELECT id FROM (SELECT id, c, pos - row_number() OVER (PARTITION BY id, c ORDER BY pos) AS gap FROM (
      SELECT id, unnest(string_split(content, '')) AS c, unnest(range(length(content))) AS pos FROM src) WHERE c NOT IN (chr(10), chr(13), chr(133)))
      GROUP BY id, c, gap HAVING count(*) >= 8)"""
    tests = {
        "too_short": f"{n} < 120", "too_long": f"{n} > 2500", "low_alpha_density": f"{letters} / {n} < 0.3",
        "ocr_noise": f"id IN {noise} OR regexp_matches(content, '{SYMBOLS}')", "broken_spacing": SPACED.format("content"),
        "missing_title": "coalesce(title, '') = ''",
        "poor_title_quality": f"coalesce(title, '') <> '' AND (length({s_trim('title')}) < 3 OR NOT regexp_matches(title, '[A-Za-z_]'))",
        "missing_grade": "NOT g", "missing_subject": "NOT s", "missing_topic": "NOT t", "ocr_detected": "ocr",
        "low_educational_value": r"NOT regexp_matches(content, '[a-zA-Z\x{0600}-\x{06FF}0-9]')", "duplicate": "dup",
    }
    flags = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in tests.items())
    lost = " + ".join(f"CASE WHEN list_contains(fl, '{k}') THEN {w} ELSE 0 END" for k, w in _PENALTY.items())
    return f"""(WITH src AS MATERIALIZED (SELECT * FROM {src}), a AS (
      SELECT *, {n} = 0 AS empty, CASE WHEN {n} = 0 THEN ['empty_content'] ELSE list_filter([{flags}], lambda v: v IS NOT NULL) END AS fl FROM src),
    b AS (SELECT *, CASE WHEN empty THEN 0 ELSE greatest(0, 100 - ({lost})) END AS pts FROM a),
    c AS (SELECT *, empty OR (NOT dup AND pts < 45) AS is_rejected FROM b)
    SELECT *, CAST(pts / 100.0 AS DOUBLE) AS quality_score, array_to_string(fl, ',') || CASE WHEN is_rejected AND NOT empty THEN CASE WHEN len(fl) > 0 THEN ',' ELSE '' END || 'below_quality_threshold' ELSE '' END AS flags,
      CASE WHEN is_rejected THEN 'rejected' WHEN dup THEN 'duplicate' WHEN len(fl) > 0 THEN 'needs_review' ELSE 'clean' END AS repair_status FROM c)"""


_DOC_ROWS = f"""(SELECT doc_id AS id, text AS content, {TITLE.format(s_trim('split_part(text, chr(10), 1)'), 'NULL')} AS title, false AS ocr,
  lang IN ('en', 'fr') AS g, lang <> 'es' AS s, n_chars > 500 AS t, row_number() OVER (PARTITION BY source, md5({s_norm('text')}) ORDER BY doc_id) > 1 AS dup FROM documents)"""


@query("quality_score", f"SELECT id AS doc_id, flags, quality_score, repair_status, is_rejected FROM {_scored_sql(_DOC_ROWS)}")
def quality_score(spark, sf):
    from daftar.functions.text import content_hash

    lang = F.col("lang")
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"),
        content_hash(F.col("text")).alias("content_hash"), detect_title(F.col("text"), F.lit(None).cast("string")).alias("title"),
        F.lit(False).alias("ocr_detected"), lang.isin("en", "fr").alias("has_grade"), (lang != "es").alias("has_subject"), (F.col("n_chars") > 500).alias("has_topic"),
    )
    flagged = quality.content_flags(rows).select("document_id", "chunk_index", "content_hash", "flags")
    scored = quality.finish_score(dedup.mark_duplicates_in_document(flagged))
    return scored.select(F.col("chunk_index").alias("doc_id"), F.array_join("flags", ",").alias("flags"), "quality_score", "repair_status", "is_rejected")


_FIXED_ROWS = f"""(SELECT doc_id * 1000000 + window_index AS id, content, lang, {TITLE.format(s_trim('split_part(content, chr(10), 1)'), 'NULL')} AS title, false AS ocr,
  lang IN ('en', 'fr') AS g, lang <> 'es' AS s, true AS t, row_number() OVER (PARTITION BY md5({s_norm('content')}) ORDER BY doc_id, window_index) > 1 AS dup
  FROM {_FIXED} JOIN documents USING (doc_id) WHERE length(content) >= 100)"""


@query("chunk_quality_rollup", f"""
SELECT lang AS language, count(*) AS chunks, count(*) FILTER (WHERE repair_status = 'clean') AS clean, count(*) FILTER (WHERE repair_status = 'needs_review') AS needs_review,
  count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE is_rejected) AS rejected FROM {_scored_sql(_FIXED_ROWS)} GROUP BY 1""")
def chunk_quality_rollup(spark, sf):
    """Fixed chunks of all documents, de-duplicated over the corpus, scored and counted."""
    from daftar.functions.text import content_hash
    from daftar.operators import health

    cut = chunking.chunk_fixed(table(spark, sf, "documents").select(F.struct("doc_id", "lang").alias("doc"), "text"), "doc")
    lang, content = F.col("doc.lang"), F.col("content")
    rows = cut.select(
        (F.col("doc.doc_id") * 1_000_000 + F.col("window_index")).alias("chunk_id"), lang.alias("language"), content, content_hash(content).alias("content_hash"),
        detect_title(content, F.lit(None).cast("string")).alias("title"), F.lit(False).alias("ocr_detected"),
        lang.isin("en", "fr").alias("has_grade"), (lang != "es").alias("has_subject"), F.lit(True).alias("has_topic"),
    )
    # Flags are set in the scan stage, so no text travels to find the copies.
    flagged = quality.content_flags(rows).select("chunk_id", "language", "content_hash", "flags")
    return health.quality_scan_rollup(quality.finish_score(dedup.dedup_global(flagged)), "language")


_PAGE_ROWS = f"""(SELECT document_id * 1000000 + chunk_index AS id, document_id, content, title, ocr_detected AS ocr, language = 'en' AS g, language IN ('en', 'fr') AS s,
  language <> 'de' AS t, row_number() OVER (PARTITION BY document_id, content_hash ORDER BY chunk_index) > 1 AS dup FROM {_TITLED})"""


@query("quality_scan_rollup", f"""
SELECT document_id, count(*) AS chunks, count(*) FILTER (WHERE repair_status = 'clean') AS clean, count(*) FILTER (WHERE repair_status = 'needs_review') AS needs_review,
  count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE is_rejected) AS rejected FROM {_scored_sql(_PAGE_ROWS)} GROUP BY 1""")
def quality_scan_rollup(spark, sf):
    """The review path from pages to scored chunks, counted per document."""
    from daftar.operators import health

    scored = review.scored_chunks(base.stored_pages(spark, sf), _classes(spark, sf))
    return health.quality_scan_rollup(scored, "document_id")


# --- model stages -------------------------------------------------------------------

_ALLOWED = ["الأولى إعدادي", "الثانية إعدادي"]


@query("classify_documents", f"""
SELECT file_id AS document_id, CASE WHEN l IN ('{_ALLOWED[0]}', '{_ALLOWED[1]}') THEN l END AS grade_name, topic_title AS title, lang AS language FROM (
  SELECT file_id, topic_title, {_grade_sql(1)} AS l, CASE WHEN regexp_matches(n, '(?i){names.FRENCH_MARKS}') THEN 'fr' ELSE 'en' END AS lang FROM {_TOPIC})""")
def classify_documents(spark, sf):
    docs = base.filenames(spark, sf).select(F.col("file_id").alias("document_id"), "filename")
    grades = spark.createDataFrame([(g,) for g in _ALLOWED], "name string")
    out = models.classify_documents(docs, None, grades, base.subjects(spark, sf))
    return out.select("document_id", "grade_name", "title", "language")


_TURNS = """(SELECT a.conv_id, a.turn, a.text AS o, CASE WHEN a.role = 'system' THEN '' ELSE b.text END AS r,
    CASE WHEN a.role = 'user' THEN length(b.text) % 100 / 100.0 END AS score, a.role = 'assistant' AND length(a.text) > 900 AS failed
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
_W = "list_filter(string_split_regex(lower({0}), '" + WS.replace("{", "{{").replace("}", "}}") + "+'), lambda t: length(t) > 2)"


@query("repair_chunks", f"""
WITH a AS (SELECT *, CASE WHEN failed OR {s_trim('r')} = '' THEN o ELSE {s_trim('r')} END AS txt, coalesce(score, 0.8) AS sc FROM {_TURNS}),
b AS (SELECT *, {_W.format(s_norm('o'))} AS ow, {_W.format(s_norm('txt'))} AS rw FROM a)
SELECT conv_id, turn, txt AS repaired_content, CASE WHEN NOT failed THEN CAST(round(sc, 3) AS DOUBLE) END AS quality_score_after,
  NOT failed AND coalesce(len(list_filter(rw, lambda t: NOT list_contains(ow, t))) / nullif(len(rw), 0) > 0.35 AND length(txt) > length(o) * 1.2, false) AS generated_content,
  CASE WHEN failed THEN 'needs_review' WHEN sc < 0.5 THEN 'rejected' ELSE 'auto_repaired' END AS repair_status FROM b""")
def repair_chunks(spark, sf):
    """Repair gating with the next turn of each conversation as the model's answer."""
    conv = table(spark, sf, "conversations")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    failed = (F.col("role") == "assistant") & (F.length("text") > 900)
    answer = F.struct(
        F.when(F.col("role") == "system", "").otherwise(F.col("r")).alias("repaired_content"), F.lit(None).cast("string").alias("detected_language"),
        F.lit(None).cast("string").alias("suggested_title"), F.when(F.col("role") == "user", F.length("r") % 100 / 100.0).alias("quality_score_after"),
        F.lit(False).alias("generated_content"), F.when(failed, "boom").alias("error"),
    )
    rows = conv.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("content"), F.col("text").alias("original_content"), F.lit("t").alias("title"),
        F.lit("fr").alias("language"), F.lit("needs_review").alias("repair_status"), answer.alias("repair"),
    )
    return models.gate_repairs(rows).select("conv_id", "turn", "repaired_content", "quality_score_after", "generated_content", "repair_status")


@query("repair_model_stage", f"""
SELECT chunk_id, CASE WHEN contains(content, '###') OR {s_trim("replace(content, '%%%', '')")} = '' THEN content ELSE {s_trim("replace(content, '%%%', '')")} END AS repaired_content,
  CASE WHEN NOT contains(content, '###') THEN 0.9::DOUBLE END AS quality_score_after, CASE WHEN contains(content, '###') THEN 'needs_review' ELSE 'auto_repaired' END AS repair_status,
  CASE WHEN contains(content, '###') THEN 'unreadable' END AS repair_error FROM {CHUNKS} WHERE repair_status = 'needs_review'""")
def repair_model_stage(spark, sf):
    """The repair stage with a model function that fails on some rows."""
    def factory():
        def fn(frame: pd.DataFrame) -> pd.DataFrame:
            if frame["content"].str.contains("###").any():
                raise ValueError("unreadable")
            n = len(frame)
            return pd.DataFrame({
                "repaired_content": frame["content"].str.replace("%%%", ""), "detected_language": [None] * n, "suggested_title": [None] * n,
                "quality_score_after": [0.9] * n, "repair_notes": [["cleaned"]] * n, "generated_content": [False] * n,
            })
        return fn

    rows = base.chunks(spark, sf).select("chunk_id", "content", "original_content", "language", "repair_status", F.lit("t").alias("title"), F.array(F.lit("ocr_noise")).alias("flags"))
    return models.repair_chunks(rows, factory).select("chunk_id", "repaired_content", "quality_score_after", "repair_status", "repair_error")


@query("apply_edits", f"""
WITH e AS (SELECT chunk_id AS k, CASE WHEN language = 'fr' THEN content || ' ' || chr(9) || 'fin' WHEN language = 'en' THEN content END AS c,
    CASE WHEN language = 'es' THEN 'rejected' END AS st, CASE WHEN language = 'fr' THEN 'revu' END AS l FROM {CHUNKS} WHERE language <> 'de'),
j AS (SELECT b.*, k, st, l, coalesce({s_norm('c')}, content) AS txt, c IS NOT NULL AND {s_norm('c')} IS DISTINCT FROM content AS changed FROM {CHUNKS} b LEFT JOIN e ON chunk_id = k)
SELECT chunk_id, txt AS content, coalesce(l, language) AS language, coalesce(st, repair_status) AS repair_status, CASE WHEN changed THEN md5({s_norm('txt')}) ELSE content_hash END AS content_hash,
  CASE WHEN changed THEN 'pending' ELSE embedding_status END AS embedding_status, is_active AND coalesce(st, '') <> 'rejected' AS is_active, changed AS content_changed FROM j""")
def apply_edits(spark, sf):
    c = base.chunks(spark, sf)
    lang = F.col("language")
    edits = c.filter("language <> 'de'").select(
        "chunk_id", F.when(lang == "fr", F.concat("content", F.lit(" \tfin"))).when(lang == "en", F.col("content")).alias("content"),
        F.when(lang == "es", "rejected").alias("repair_status"), F.when(lang == "fr", "revu").alias("language"), F.col("created_at").alias("edited_at"),
    )
    out = edit.apply_edits(c, edits)
    return out.select("chunk_id", "content", "language", "repair_status", "content_hash", "embedding_status", "is_active", "content_changed")


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _letter_embedder():
    """A model function with a SQL twin: how often each letter occurs."""
    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        lower = frame["text"].str.lower()
        return pd.DataFrame({"embedding": [[float(t.count(a)) for a in _ALPHABET] for t in lower]})

    return fn


def _letters(x: str) -> str:
    """SQL twin of the letter counts of ``x`` (lower case)."""
    return "[" + ", ".join(f"CAST(length({x}) - length(replace({x}, '{a}', '')) AS DOUBLE)" for a in _ALPHABET) + "]"


def _embedded(spark, sf):
    return models.embed_chunks(filters.embed_eligible(base.chunks(spark, sf)), _letter_embedder, 26)


@query("embed_chunks", f"""
SELECT chunk_id, array_to_string(list_transform({_letters('x')}, lambda v: CAST(v AS INTEGER)), ',') AS vector, 'done' AS embedding_status, 'embedded' AS repair_status, 'hashing' AS embedding_model
FROM (SELECT chunk_id, lower('passage: ' || content) AS x FROM {CHUNKS} WHERE is_active AND repair_status IN ('clean', 'embedded', 'auto_repaired') AND content_hash IS NOT NULL)""")
def embed_chunks(spark, sf):
    vector = F.array_join(F.transform("embedding", lambda v: v.cast("int").cast("string")), ",")
    return _embedded(spark, sf).select("chunk_id", vector.alias("vector"), "embedding_status", "repair_status", "embedding_model")


@query("embed_status", f"""
SELECT document_id, count(*) AS done FROM {CHUNKS} WHERE is_active AND repair_status IN ('clean', 'embedded', 'auto_repaired') AND content_hash IS NOT NULL GROUP BY 1""")
def embed_status(spark, sf):
    done = _embedded(spark, sf).filter((F.col("embedding_status") == "done") & (F.size("embedding") == 26))
    return done.groupBy("document_id").agg(F.count("*").alias("done"))


@query("retrieval_test", f"""
WITH v AS MATERIALIZED (SELECT chunk_id, document_id, {_letters('x')} AS c, {_letters('y')} AS q FROM (
  SELECT chunk_id, document_id, lower(content) AS x, lower('Chunk ' || left(content, 240)) AS y FROM {CHUNKS})),
p AS (SELECT a.chunk_id AS query_id, b.chunk_id, round(coalesce(list_dot_product(a.q, b.c) / nullif(sqrt(list_dot_product(a.q, a.q)) * sqrt(list_dot_product(b.c, b.c)), 0), 0), 9) AS score FROM v a JOIN v b USING (document_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM p)
SELECT query_id, bool_or(chunk_id = query_id) AS passed, min(CASE WHEN chunk_id = query_id THEN r END) AS rank, round(max(score), 4) AS top_score FROM r WHERE r <= 5 GROUP BY 1""", as_text=("rank",))
def retrieval_test(spark, sf):
    """Chunks of each source asked with their own opening, after embedding both."""
    c = base.chunks(spark, sf).select("chunk_id", "document_id", "content")
    embedder = _letter_embedder
    corpus = durable(models.embed_text(c, embedder, F.col("content"), 26).drop("content"), "vectors")
    ask = retrieval.query_text(F.lit(None).cast("string"), F.col("content"))
    asked = models.embed_text(c, embedder, ask, 26).drop("content").withColumnRenamed("chunk_id", "query_id")
    asked = durable(asked, "queries")
    return retrieval.retrieval_test(asked, corpus, 5, scope="document_id").select("query_id", "passed", "rank", "top_score")


_QA = """(SELECT a.conv_id, a.turn, a.text AS q, b.text AS a FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query("generate_qa", f"""
SELECT conv_id, turn, CAST(i AS INTEGER) AS pair_index, {s_trim('q')} AS question, {s_trim('a')} AS answer FROM (
  SELECT conv_id, turn, 0 AS i, q, a FROM {_QA} UNION ALL SELECT conv_id, turn, 1, left(q, 5), a FROM {_QA} UNION ALL SELECT conv_id, turn, 2, a, ' ' || q || ' ' FROM {_QA})
WHERE length({s_trim('q')}) > 5 AND length({s_trim('a')}) > 5""")
def generate_qa(spark, sf):
    conv = table(spark, sf, "conversations")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    q, a = F.col("text"), F.col("a")

    def pair(x, y):
        return F.struct(x.alias("question"), y.alias("answer"))

    pairs = F.array(pair(q, a), pair(F.left(q, F.lit(5)), a), pair(a, F.concat(F.lit(" "), q, F.lit(" "))))
    raw = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(pairs.alias("pairs"))), F.lit("\n```"))
    rows = conv.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", raw.alias("answer_text"))
    return models.extract_pairs(rows)


@query("qa_model_stage", f"""
SELECT chunk_id, document_id AS grade_id, 0 AS pair_index, 'What does it say?' AS question, q AS answer FROM (
  SELECT *, {s_trim("regexp_replace(content, '[^\\p{L}\\p{N} ]', '', 'g')")} AS q FROM {CHUNKS} WHERE embedding_status = 'done') WHERE length(q) > 5""")
def qa_model_stage(spark, sf):
    """Question generation end to end with a function that quotes the text."""
    def factory():
        def fn(frame: pd.DataFrame) -> pd.DataFrame:
            def answer(t: str) -> str:
                quote = "".join(ch for ch in (t or "") if ch.isalnum() or ch == " ")
                return '{"pairs":[{"question":"What does it say?","answer":"%s"}]}' % quote
            return pd.DataFrame({"answer_text": frame["content"].map(answer)})
        return fn

    rows = base.chunks(spark, sf).select(
        "chunk_id", "content", "embedding_status", F.lit(False).alias("qa_generated"), F.col("document_id").alias("grade_id"),
        F.try_element_at("metadata", F.lit("grade")).alias("grade"), F.try_element_at("metadata", F.lit("subject")).alias("subject"),
    )
    pairs, _ = models.generate_qa(rows, factory)
    return pairs


@query("question_match", f"""
SELECT query_id, question_id, answer, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, question_id) AS r FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS question_id, 'a' || c.label AS answer, c.label AS chunk_id, round({s_cosine('q.embedding', 'c.embedding')}, 9) AS score
  FROM embeddings q, embeddings c)) WHERE r <= 2""")
def question_match(spark, sf):
    e = table(spark, sf, "embeddings")
    asked = e.select(F.col("vec_id").alias("query_id"), "embedding")
    stored = e.select(
        F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_embedding"), F.concat(F.lit("a"), F.col("label").cast("string")).alias("answer"), F.col("label").alias("chunk_id")
    )
    return retrieval.question_match(asked, stored, 2).drop("rank")


_PIECES = f"""(SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 3000 + 1)) AS i FROM documents WHERE lang IN ('en', 'fr') AND length(text) > 0)"""


@query("format_documents", f"""
WITH f AS (SELECT doc_id, string_agg(CASE WHEN length(p) > 50 THEN {s_trim("replace(p, 'e', 'E')")} ELSE p END, '' ORDER BY i) AS t
  FROM (SELECT doc_id, i, substr(text, i * 3000 + 1, 3000) AS p FROM {_PIECES}) GROUP BY 1)
SELECT d.doc_id AS document_id, coalesce(t, text) AS text FROM documents d LEFT JOIN f USING (doc_id)""")
def format_documents(spark, sf):
    """The two formatted subjects, with a formatter that marks every ``e``."""
    def factory():
        return lambda frame: pd.DataFrame({"formatted": frame["piece_text"].str.replace("e", "E")})

    subject = F.when(F.col("lang") == "en", names.MATHS).when(F.col("lang") == "fr", names.ISLAMIC).otherwise(names.PHYSICS)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text", subject.alias("subject_hint"))
    return models.format_documents(docs, factory).select("document_id", "text")


# --- whole plans ---------------------------------------------------------------------

def _files(spark, sf):
    """Documents under names that carry grade, topic and subject."""
    lang = F.col("lang")
    subject = F.when(lang == "en", "anglais").when(lang == "fr", "math")
    name = F.concat_ws("-", F.lit("red_ring"), F.lit("1bac"), subject, F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.concat(name, F.lit(".pdf")).alias("filename"), "text")


_NAME = "concat_ws('-', 'red_ring', '1bac', CASE lang WHEN 'en' THEN 'anglais' WHEN 'fr' THEN 'math' END, doc_id)"
_REVIEW_ROWS = f"""(SELECT document_id * 1000000 + chunk_index AS id, document_id, chunk_index, page_start, page_end, content, {TITLE.format('line', 'name')} AS title,
    ocr_detected AS ocr, lang IN ('en', 'fr') AS g, true AS s, true AS t, row_number() OVER (PARTITION BY document_id, md5(content) ORDER BY chunk_index) > 1 AS dup
  FROM (SELECT a.*, lang, {_NAME} AS name, {s_trim('split_part(content, chr(10), 1)')} AS line FROM {_DRAFTS} a JOIN documents ON doc_id = document_id))"""


def _classifier():
    """A model function that reads the subject word in the file name."""
    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        known = frame["filename"].str.contains("anglais|math")
        return pd.DataFrame({
            "grade_name": [_ALLOWED[0] if k else "not listed" for k in known], "subject_name": ["Brand#1"] * len(frame),
            "title": frame["filename"].str.removesuffix(".pdf"), "language": ["fr"] * len(frame), "quality_notes": [[]] * len(frame),
        })

    return fn


@query("prepare_corpus", f"""
SELECT document_id, chunk_index, page_start, page_end, quality_score, CASE repair_status WHEN 'clean' THEN 'embedded' ELSE repair_status END AS repair_status,
  CASE repair_status WHEN 'clean' THEN 'done' END AS embedding_status FROM {_scored_sql(_REVIEW_ROWS)}""")
def prepare_corpus(spark, sf):
    """The whole review path with a classifier, over all documents."""
    docs = _files(spark, sf).withColumnRenamed("file_id", "document_id")
    grades = spark.createDataFrame([(g,) for g in _ALLOWED], "name string")
    done = review.prepare_corpus(docs, grades, base.subjects(spark, sf), models.hashing_embedder(64), 64, _classifier, separator="\n")
    return done.chunks.select("document_id", "chunk_index", "page_start", "page_end", "quality_score", "repair_status", "embedding_status")


def _count_sql(stage, counter, of="count(*)", rows="x"):
    return f"SELECT '{stage}' AS stage, '{counter}' AS counter, CAST({of} AS BIGINT) AS value FROM {rows}"


@query("prepare_metrics", f"WITH x AS (SELECT * FROM {_scored_sql(_REVIEW_ROWS)}) " + " UNION ALL ".join([
    _count_sql("pages", "rows", rows=PAGES), _count_sql("pages", "low_text", "count(*) FILTER (WHERE low_text)", PAGES),
    _count_sql("scored", "rows"), *[_count_sql("scored", s, f"count(*) FILTER (WHERE repair_status = '{s}')") for s in ("clean", "needs_review", "embedded", "rejected")],
    _count_sql("scored", "duplicates", "count(*) FILTER (WHERE dup)", _REVIEW_ROWS),
    _count_sql("chunks", "rows"), _count_sql("chunks", "clean", "0 * count(*)"), _count_sql("chunks", "embedded", "count(*) FILTER (WHERE repair_status = 'clean')"),
    *[_count_sql("chunks", s, f"count(*) FILTER (WHERE repair_status = '{s}')") for s in ("needs_review", "rejected")],
    _count_sql("chunks", "vectors", "count(*) FILTER (WHERE repair_status = 'clean')"), _count_sql("chunks", "vectors_failed", "0 * count(*)"),
]))
def prepare_metrics(spark, sf):
    """Counts that the review path observed in its own writes, against a recount."""
    docs = _files(spark, sf).withColumnRenamed("file_id", "document_id")
    grades = spark.createDataFrame([(g,) for g in _ALLOWED], "name string")
    done = review.prepare_corpus(docs, grades, base.subjects(spark, sf), models.hashing_embedder(64), 64, _classifier, separator="\n")
    return review.metrics_table(spark, done)


_REPAIRABLE = "repair_status = 'needs_review' AND page_start % 7 <> 0"


@query("prepare_corpus_repaired", f"""
SELECT document_id, chunk_index,
  CASE WHEN {_REPAIRABLE} THEN CASE WHEN page_start % 2 = 1 THEN 'embedded' ELSE 'rejected' END WHEN repair_status = 'clean' THEN 'embedded' ELSE repair_status END AS repair_status,
  CASE WHEN {_REPAIRABLE} THEN CASE WHEN page_start % 2 = 1 THEN '0.9' ELSE '0.3' END END AS quality_score_after,
  CASE WHEN {_REPAIRABLE} THEN 'page ' || page_start END AS notes,
  CASE WHEN repair_status = 'needs_review' AND page_start % 7 = 0 THEN 'unreadable' END AS repair_error
FROM {_scored_sql(_REVIEW_ROWS)}""", as_text=("quality_score_after",))
def prepare_corpus_repaired(spark, sf):
    """The review path with a classifier and a repairer that rejects some chunks and fails on others."""
    def repairer():
        def fn(frame: pd.DataFrame) -> pd.DataFrame:
            page = frame["page_start"].astype(int)
            if (page % 7 == 0).any():
                raise ValueError("unreadable")
            n = len(frame)
            return pd.DataFrame({
                "repaired_content": [None] * n, "detected_language": [None] * n, "suggested_title": [None] * n, "quality_score_after": [0.9 if p % 2 else 0.3 for p in page],
                "repair_notes": [[f"page {p}"] for p in page], "generated_content": [False] * n,
            })
        return fn

    docs = _files(spark, sf).withColumnRenamed("file_id", "document_id")
    grades = spark.createDataFrame([(g,) for g in _ALLOWED], "name string")
    done = review.prepare_corpus(docs, grades, base.subjects(spark, sf), models.hashing_embedder(64), 64, _classifier, repairer, separator="\n")
    return done.chunks.select("document_id", "chunk_index", "repair_status", "quality_score_after", F.array_join("repair_notes", ",").alias("notes"), "repair_error")


@query("ingest_corpus", f"""
SELECT content_hash, doc_id AS file_id, chunk_index, CAST(length(content) AS INTEGER) AS chunk_size, (SELECT min(p_partkey) FROM part WHERE contains(p_name, 'red ring')) AS source_id,
  '1bac' AS grade_hint, CASE lang WHEN 'en' THEN '{names.ENGLISH}' WHEN 'fr' THEN '{names.MATHS}' END AS subject_hint, 'done' AS embedding_status FROM (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY md5(doc_id || ':' || chunk_index)) AS r FROM (
    SELECT doc_id, lang, content, md5(content) AS content_hash, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index
    FROM {_WINDOWS} JOIN documents d USING (doc_id) WHERE length(content) >= 100 AND length({s_trim('d.text')}) >= 50))
WHERE r = 1 AND content_hash NOT IN (SELECT content_hash FROM {CHUNKS} WHERE content_hash IS NOT NULL)""")
def ingest_corpus(spark, sf):
    dims = ingest.Dimensions(
        base.grades(spark, sf), base.cycles(spark, sf), base.subjects(spark, sf), base.topics(spark, sf), aliases.alias_index(aliases.default_aliases(spark))
    )
    store = base.chunks(spark, sf).select("content_hash", "metadata")
    rows, _ = ingest.ingest_corpus(_files(spark, sf), store, dims, models.hashing_embedder(64), 64)
    return rows.select("file_id", "chunk_index", "chunk_size", "content_hash", "source_id", "grade_hint", "subject_hint", "embedding_status")


@query("ingest_corpus_counters", f"""
WITH w AS (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY md5(doc_id || ':' || chunk_index)) = 1
    AND content_hash NOT IN (SELECT content_hash FROM {CHUNKS} WHERE content_hash IS NOT NULL) AS fresh FROM (
    SELECT doc_id, md5(content) AS content_hash, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index
    FROM {_WINDOWS} JOIN documents d USING (doc_id) WHERE length(content) >= 100 AND length({s_trim('d.text')}) >= 50))
SELECT {_NAME} || '.pdf' AS filename, count(*) FILTER (WHERE fresh) AS inserted, count(*) FILTER (WHERE fresh) AS embedded,
  count(*) FILTER (WHERE NOT fresh) AS skipped, count(*) FILTER (WHERE fresh IS NULL) AS skipped_short
FROM documents LEFT JOIN w USING (doc_id) GROUP BY 1""")
def ingest_corpus_counters(spark, sf):
    """Counters of every file, also of those too short to give a chunk; with a formatter that changes nothing."""
    dims = ingest.Dimensions(
        base.grades(spark, sf), base.cycles(spark, sf), base.subjects(spark, sf), base.topics(spark, sf), aliases.alias_index(aliases.default_aliases(spark))
    )
    store = base.chunks(spark, sf).select("content_hash", "metadata")
    _, counters = ingest.ingest_corpus(_files(spark, sf), store, dims, models.hashing_embedder(64), 64, _plain_formatter)
    return counters


def _plain_formatter():
    return lambda frame: pd.DataFrame({"formatted": [None] * len(frame)})


@query("ingest_chunks", f"""
SELECT content_hash, doc_id AS file_id, chunk_index FROM (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY md5(doc_id || ':' || chunk_index)) AS r FROM (
    SELECT doc_id, md5(content) AS content_hash, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index
    FROM {_WINDOWS} JOIN documents d USING (doc_id) WHERE length(content) >= 100 AND length({s_trim('d.text')}) >= 50))
WHERE r = 1 AND content_hash NOT IN (SELECT md5(text) FROM documents)""")
def ingest_chunks(spark, sf):
    """The ingest path up to de-duplication against what is stored."""
    store = table(spark, sf, "documents").select(F.md5("text").alias("content_hash"))
    return dedup.dedup_against_store(ingest.file_chunks(_files(spark, sf)), store).select("content_hash", "file_id", "chunk_index")


_CLEANED = f"""(SELECT chunk_id, coalesce(content_hash, md5(content)) AS content_hash, embedding, source_id,
  CASE WHEN embedding IS NULL AND embedding_status IN ('failed', 'processing') THEN 'pending' WHEN embedding_status IS NOT NULL THEN embedding_status
       WHEN embedding IS NOT NULL THEN 'done' ELSE 'pending' END AS embedding_status
  FROM {CHUNKS} WHERE length({s_trim('content')}) >= 50 AND NOT ((md_grade IS NULL OR md_grade = 'null') AND (md_subject IS NULL OR md_subject = 'null')))"""


@query("cleanup_corpus", f"SELECT chunk_id, content_hash, embedding_status FROM {_CLEANED}")
def cleanup_corpus(spark, sf):
    return cleanup.cleanup_corpus(base.chunks(spark, sf)).select("chunk_id", "content_hash", "embedding_status")


_REPORT = "SELECT '{0}' AS phase, embedding_status, count(*) AS total, count(*) FILTER (WHERE embedding IS NULL) AS missing_vector, count(*) FILTER (WHERE source_id IS NULL) AS missing_source_id FROM {1} GROUP BY 2"


@query("cleanup_report", _REPORT.format("before", CHUNKS) + " UNION ALL " + _REPORT.format("after", _CLEANED))
def cleanup_report(spark, sf):
    before = base.chunks(spark, sf)
    return cleanup.cleanup_report(before, cleanup.cleanup_corpus(before))


@query("reset_embeddings", f"SELECT chunk_id, embedding IS NULL AND false AS has_vector, 'pending' AS embedding_status, CAST(NULL AS TIMESTAMP) AS embedding_claimed_at FROM {CHUNKS}")
def reset_embeddings(spark, sf):
    out = edit.reset_embeddings(base.chunks(spark, sf))
    return out.select("chunk_id", F.col("embedding").isNotNull().alias("has_vector"), "embedding_status", "embedding_claimed_at")


