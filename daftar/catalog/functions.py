"""Scalar text, vector, JSON and name functions (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from daftar.catalog import base
from daftar.catalog.base import AR, CHUNKS, FILENAMES, WS, query, s_cosine, s_norm, s_re, s_trim, table
from daftar.functions import data, names, text
from daftar.operators import aliases


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


@query("normalize_content", f"SELECT doc_id, {s_norm('text')} AS content FROM documents")
def normalize_content(spark, sf):
    return _docs(spark, sf).select("doc_id", text.normalize_content(F.col("text")).alias("content"))


@query("content_hash", f"SELECT doc_id, md5({s_norm('text')}) AS content_hash FROM documents")
def content_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


_TOKEN = s_trim(s_re("strip_accents(lower({0}))", r"[^a-z0-9\x{0600}-\x{06FF}]+", "' '")).replace("{0600}", "{{0600}}").replace("{06FF}", "{{06FF}}")


@query("normalise_token", f"SELECT doc_id, {_TOKEN.format('text')} AS token FROM documents")
def normalise_token(spark, sf):
    return _docs(spark, sf).select("doc_id", names.normalise_token(F.col("text")).alias("token"))


@query("normalise_arabic", f"""SELECT doc_id, translate(regexp_replace(x, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]', '', 'g'), 'أإآٱىة', 'اااايه') AS folded
FROM (SELECT doc_id, 'أُولَى ' || lang || ' السنة إعدادي ' || text AS x FROM documents)""")
def normalise_arabic(spark, sf):
    x = F.concat(F.lit("أُولَى "), "lang", F.lit(" السنة إعدادي "), "text")
    return _docs(spark, sf).select("doc_id", names.normalise_arabic(x).alias("folded"))


_SLUG = "trim(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"


@query("slugify_label", f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents")
def slugify_label(spark, sf):
    return _docs(spark, sf).select("doc_id", names.slugify_label(F.col("text")).alias("slug"))


_NAME = s_trim(s_re(s_re(s_re("regexp_replace(filename, '\\.[^.]+$', '')", "[_–—]+", "'-'"), WS + "*-" + WS + "*", "'-'"), WS + "+", "' '"))
_NAMED = f"(SELECT file_id, {_NAME} AS n FROM {FILENAMES})"


def _named(spark, sf):
    return base.filenames(spark, sf).select("file_id", names.normalise_filename(F.col("filename")).alias("n"))


@query("normalise_filename", f"SELECT * FROM {_NAMED}")
def normalise_filename(spark, sf):
    return _named(spark, sf)


@query("detect_language", f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{AR}') THEN 'ar'
  WHEN regexp_matches(text, '(?i){names.FRENCH_MARKS}') THEN 'fr' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language FROM documents""")
def detect_language(spark, sf):
    return _docs(spark, sf).select("doc_id", names.detect_language(F.col("text")).alias("language"))


def _grade_sql(pick: int, n: str = "n") -> str:
    """The grade rules for an engine without look-ahead."""
    cases = []
    for rule in names.GRADE_RULES:
        pattern = "|".join(f"(?:{p})" for p in rule[2]).replace("(?=$|", "(?:$|")
        cases.append(f"WHEN regexp_matches(translate({n}, 'أإآٱىة', 'اااايه'), '(?i){pattern}') THEN '{rule[pick]}'")
    return f"CASE {' '.join(cases)} END"


@query("detect_grade", f"SELECT file_id, {_grade_sql(0)} AS grade_slug, {_grade_sql(1)} AS grade_label FROM {_NAMED}")
def detect_grade(spark, sf):
    n = F.col("n")
    return _named(spark, sf).select("file_id", names.detect_grade_slug(n).alias("grade_slug"), names.detect_grade_label(n).alias("grade_label"))


_TYPE = "CASE " + " ".join(
    f"WHEN regexp_matches(n, '(?i){names.type_pattern(arabic, french, chr(92) + 'b')}') THEN '{k}'" for k, arabic, french in names.TYPE_WORDS
) + " ELSE 'unknown' END"


@query("detect_document_type", f"SELECT file_id, {_TYPE} AS document_type FROM {_NAMED}")
def detect_document_type(spark, sf):
    return _named(spark, sf).select("file_id", names.detect_document_type(F.col("n")).alias("document_type"))


_VAR = names.VARIANT
_VARIANT_SQL = f"nullif({s_re(f'''regexp_extract(n, '(?i)(?:{_VAR})')''', WS + '+')}, '')"


@query("detect_variant", f"SELECT file_id, {_VARIANT_SQL} AS variant FROM {_NAMED}")
def detect_variant(spark, sf):
    return _named(spark, sf).select("file_id", names.detect_variant(F.col("n")).alias("variant"))


def _topic_sql() -> str:
    x = s_re("n", f"(?i)(?:{_VAR})", "' '")
    x = s_re(x, "|".join(arabic for _, arabic, _ in names.TYPE_WORDS), "' '")
    x = s_re(x, rf"(?i)\b(?:{'|'.join(french for _, _, french in names.TYPE_WORDS)})\b", "' '")
    x = s_re(x, rf"(?i)\b(?:{names.PLACEHOLDERS})\b", "' '")
    x = s_re(x, rf"\({WS}*[0-9]+{WS}*\)", "' '")
    for slug, _, patterns in names.GRADE_RULES:
        for p in patterns:
            p = p.replace("(?=$|", "(?:$|")
            x = _once(x, slug, p)
    x = s_re(x, rf"(?i)\b(?:{names.FILE_WORDS})\b", "' '")
    x = s_re(x, rf"(?i)\b(?:{names.GRADE_WORDS})\b", "' '")
    x = s_re(x, rf"(?i)\b[0-9]+{WS}*(?:e|eme|ème)\b", "' '")
    x = s_re(x, r"[-_–—]+", "' '")
    return f"nullif({s_trim(s_re(x, WS + '+', chr(39) + ' ' + chr(39)))}, '')"


def _once(x: str, slug: str, pattern: str) -> str:
    """Replace the first match, unless another grade was found."""
    return f"list_transform([{x}], lambda v: CASE WHEN g IS NULL OR g = '{slug}' THEN regexp_replace(v, '(?i)(?:{pattern})', ' ') ELSE v END)[1]"


_TOPIC_SQL = _topic_sql()
_TOPIC = f"(SELECT file_id, n, g, {_TOPIC_SQL} AS topic_title FROM (SELECT *, {_grade_sql(0)} AS g FROM {_NAMED}))"


@query("cleanup_topic", f"SELECT file_id, topic_title FROM {_TOPIC}")
def cleanup_topic(spark, sf):
    rows = _named(spark, sf).withColumn("g", names.detect_grade_slug(F.col("n")))
    return rows.select("file_id", names.cleanup_topic(F.col("n"), F.col("g")).alias("topic_title"))


@query("metadata_confidence", f"""
SELECT file_id, CASE WHEN g IS NOT NULL AND topic_title IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
  concat_ws('|', CASE WHEN g IS NULL THEN '{names.GRADE_WARNING}' END, CASE WHEN topic_title IS NULL THEN '{names.TOPIC_WARNING}' END, '{names.SUBJECT_WARNING}') AS warnings
FROM {_TOPIC}""")
def metadata_confidence(spark, sf):
    n, none = F.col("n"), F.lit(None).cast("string")
    rows = _named(spark, sf).withColumn("g", names.detect_grade_slug(n))
    rows = rows.withColumn("t", names.cleanup_topic(n, F.col("g"))).withColumn("k", names.detect_document_type(n))
    return rows.select(
        "file_id", names.metadata_confidence(F.col("g"), F.col("t"), F.col("k"), none).alias("confidence"),
        F.array_join(names.metadata_warnings(F.col("g"), F.col("t"), none), "|").alias("warnings"),
    )


def _sql_map(entries: dict[str, str], x: str) -> str:
    return "CASE " + x + " " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in entries.items()) + " END"


_HINT_FILES = f"""(SELECT file_id, CASE file_id % 6 WHEN 0 THEN '2bac-' WHEN 3 THEN 'الأولى باك ' WHEN 1 THEN 'premiere bac ' WHEN 4 THEN 'première bac ' WHEN 2 THEN '1physique-' ELSE '' END ||
  CASE WHEN file_id % 5 = 0 THEN 'svt ' WHEN file_id % 5 = 1 THEN 'sciences vie ' ELSE '' END || filename AS filename FROM {FILENAMES})"""
_FIRST = "list_filter(list_transform(parts, lambda p: {0}), lambda v: v IS NOT NULL)[1]"


def _phrases(kind: str, tokens: list[tuple[str, str]]) -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in tokens)
    return f"""(SELECT file_id, arg_min(c, row(3 - n, i)) AS {kind} FROM
    (SELECT file_id, n, i, array_to_string(list_slice(parts, i, i + n - 1), ' ') AS phrase FROM f, (VALUES (3), (2), (1)) v(n), range(1, 25) r(i) WHERE i + n - 1 <= len(parts) AND s1 IS NULL)
    JOIN (VALUES {values}) a(t, c) ON t = phrase GROUP BY 1)"""


_PHRASE_GRADES = [("premiere bac", "1ère année Bac"), ("الأولى باك", "1ère année Bac"), ("premiere primaire", "1ère année primaire"), ("6eme primaire", "6ème année primaire"), ("2eme annee", "x")]
_PHRASE_SUBJECTS = [("sciences vie", names.LIFE), ("controle ring", "x")]


def _hint_aliases(spark):
    rows = [("grade", c, a, i) for i, (a, c) in enumerate(_PHRASE_GRADES)] + [("subject", c, a, i) for i, (a, c) in enumerate(_PHRASE_SUBJECTS)]
    return aliases.alias_index(spark.createDataFrame(rows, "kind string, canonical string, variant string, ord int"))


@query("parse_filename_hints", f"""
WITH f AS (SELECT *, {_FIRST.format(_sql_map(names.GRADE_TOKENS, 'p'))} AS g1, {_FIRST.format(_sql_map(names.SUBJECT_TOKENS, 'p'))} AS s1 FROM (
  SELECT file_id, filename, list_filter(string_split(regexp_replace(strip_accents(lower(regexp_replace(filename, '\\.[^.]*$', ''))), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-'), lambda p: p <> '') AS parts FROM {_HINT_FILES})),
g2 AS {_phrases('g2', _PHRASE_GRADES)}, s2 AS {_phrases('s2', _PHRASE_SUBJECTS)}
SELECT file_id, filename,
  coalesce(lower(coalesce(nullif(regexp_extract(filename, '(?i)[0-9]bac'), ''), nullif(regexp_extract(filename, '(?i)tcs'), ''), nullif(regexp_extract(filename, '(?i)[0-9]col'), ''), nullif(regexp_extract(filename, '(?i)([0-9]p)(?:rim|[^\\p{{L}}]|$)', 1), ''))), g1, g2) AS grade_hint,
  nullif(regexp_extract(regexp_replace(filename, '\\.[^.]*$', ''), '^[^-]+'), '') AS topic_hint, coalesce(s1, s2) AS subject_hint
FROM f LEFT JOIN g2 USING (file_id) LEFT JOIN s2 USING (file_id)""")
def parse_filename_hints(spark, sf):
    i = F.col("file_id")
    grade = F.try_element_at(names.literal_map({"0": "2bac-", "3": "الأولى باك ", "1": "premiere bac ", "4": "première bac ", "2": "1physique-"}), (i % 6).cast("string"))
    grade = F.coalesce(grade, F.lit(""))
    subject = F.when(i % 5 == 0, "svt ").when(i % 5 == 1, "sciences vie ").otherwise("")
    files = base.filenames(spark, sf).withColumn("filename", F.concat(grade, subject, "filename"))
    return aliases.filename_hints(files, _hint_aliases(spark))


NOISE = f"""(SELECT doc_id FROM (SELECT doc_id, c, pos - row_number() OVER (PARTITION BY doc_id, c ORDER BY pos) AS g FROM (
    SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS pos FROM documents) WHERE c NOT IN (chr(10), chr(13), chr(133)))
  GROUP BY doc_id, c, g HAVING count(*) >= 8)"""
SYMBOLS = r"[^\p{L}\p{N}\s\x0B\x{FEFF}\p{Z}]{6,}"


@query("repeated_noise", f"SELECT doc_id, doc_id IN {NOISE} OR regexp_matches(text, '{SYMBOLS}') AS noisy FROM documents")
def repeated_noise(spark, sf):
    return _docs(spark, sf).select("doc_id", text.repeated_noise(F.col("text")).alias("noisy"))


SPACED = rf"regexp_matches({{0}}, '\b[a-zA-Z]{WS}+[a-zA-Z]{WS}+[a-zA-Z]\b') OR regexp_matches({{0}}, '{AR}{WS}+{AR}{WS}+{AR}')".replace("{FEFF}", "{{FEFF}}").replace("{Z}", "{{Z}}").replace("{0600}", "{{0600}}").replace("{06FF}", "{{06FF}}")


@query("broken_spacing", f"SELECT doc_id, {SPACED.format('text')} AS spaced FROM documents")
def broken_spacing(spark, sf):
    return _docs(spark, sf).select("doc_id", text.broken_spacing(F.col("text")).alias("spaced"))


@query("alpha_density", f"""SELECT doc_id, round(length(regexp_replace(text, '[^a-zA-Z\\x{{0600}}-\\x{{06FF}}]+', '', 'g')) / nullif(length({s_trim('text')}), 0), 9) AS density FROM documents""")
def alpha_density(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(text.alpha_density(F.col("text")), 9).alias("density"))


@query("clamp_score", "SELECT l_orderkey, l_linenumber, l_partkey, least(1.0, greatest(0.0, round(l_extendedprice / 50000 - l_discount * 5, 3))) AS score FROM lineitem")
def clamp_score(spark, sf):
    raw = F.col("l_extendedprice") / 50000 - F.col("l_discount") * 5
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.clamp_score(raw).alias("score"))


@query("cosine_similarity", f"""
SELECT a.vec_id, CASE WHEN b.vec_id IS NULL THEN 0.0 ELSE round({s_cosine('a.embedding', 'b.embedding')}, 6) END AS score
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    other = F.coalesce("other", F.array().cast("array<float>"))
    return a.join(b, "vec_id", "left").select("vec_id", F.round(data.cosine_similarity(F.col("embedding"), other), 6).alias("score"))


@query("parse_vector", """
SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS INTEGER) AS n,
  CASE event_type WHEN 'view' THEN value WHEN 'click' THEN value WHEN 'error' THEN value END AS first FROM events""")
def parse_vector(spark, sf):
    v, kind = F.col("value").cast("string"), F.col("event_type")
    raw = (
        F.when(kind == "view", F.concat(F.lit("["), v, F.lit(", 1.5]"))).when(kind == "click", F.concat(v, F.lit(", 2")))
        .when(kind == "error", F.concat(F.lit("["), v, F.lit(", x]"))).when(kind == "signup", "")
    )
    vec = data.parse_vector(raw)
    return table(spark, sf, "events").select("event_id", F.size(vec).alias("n"), F.try_element_at(vec, F.lit(1)).alias("first"))


_WORDS = "list_filter(string_split_regex(lower({0}), '" + WS.replace("{", "{{").replace("}", "}}") + "+'), lambda t: length(t) > 2)"


@query("generated_content", f"""
WITH x AS (SELECT a.conv_id, a.turn, a.text AS o, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
y AS (SELECT *, {_WORDS.format(s_norm('o'))} AS ow, {_WORDS.format(s_norm('r'))} AS rw FROM x)
SELECT conv_id, turn, coalesce(len(list_filter(rw, lambda t: NOT list_contains(ow, t))) / nullif(len(rw), 0) > 0.35 AND length(r) > length(o) * 1.2, false) AS generated FROM y""")
def generated_content(spark, sf):
    a = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("o"))
    b = table(spark, sf, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", text.generated_content(F.col("o"), F.col("r")).alias("generated"))


SEGMENT = r"""CASE WHEN length({0}) < 80 THEN 'title' WHEN regexp_matches({0}, '(?i)^(?:definition|définition|تعريف)\b') THEN 'definition'
  WHEN regexp_matches({0}, '(?i)^(?:example|exemple|مثال)\b') THEN 'example' WHEN regexp_matches({0}, '(?i)^(?:exercise|exercice|تمرين)\b') THEN 'exercise' ELSE 'paragraph' END"""


@query("segment_type", f"""SELECT doc_id, {SEGMENT.format('x')} AS segment_type FROM (
  SELECT doc_id, CASE lang WHEN 'fr' THEN 'Exercice: ' WHEN 'es' THEN 'Définition ' WHEN 'de' THEN 'examples ' ELSE '' END || text AS x FROM documents)""")
def segment_type(spark, sf):
    lang = F.col("lang")
    x = F.concat(F.when(lang == "fr", "Exercice: ").when(lang == "es", "Définition ").when(lang == "de", "examples ").otherwise(""), "text")
    return _docs(spark, sf).withColumn("x", x).select("doc_id", text.segment_type(F.col("x")).alias("segment_type"))


TITLE = f"(CASE WHEN length({{0}}) BETWEEN 8 AND 120 AND regexp_matches({{0}}, '[A-Za-z_]') AND regexp_matches({{0}}, '[a-zA-Z{AR[1:-1]}]') THEN {{0}} ELSE {{1}} END)".replace("{0600}", "{{0600}}").replace("{06FF}", "{{06FF}}")


@query("detect_title", f"SELECT doc_id, {TITLE.format('x', 'lang')} AS title FROM (SELECT doc_id, lang, {s_trim('split_part(text, chr(10), 1)')} AS x FROM documents)")
def detect_title(spark, sf):
    return _docs(spark, sf).select("doc_id", text.detect_title(F.col("text"), F.col("lang")).alias("title"))


_ANSWER = """(SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Here: ```json' || chr(10) || j || '```' WHEN 'assistant' THEN j || ' done.' ELSE replace(j, '"', '') END AS a
  FROM (SELECT *, '{"grade":"' || role || '","subject":"' || turn || '"}' AS j FROM conversations))"""


@query("json_object_extract", f"""SELECT conv_id, turn, CASE WHEN a NOT LIKE '%' || chr(34) || 'grade%' THEN NULL ELSE regexp_extract(a, '"grade":"([^"]*)"', 1) END AS grade,
  CASE WHEN a NOT LIKE '%' || chr(34) || 'grade%' THEN NULL ELSE regexp_extract(a, '"subject":"([^"]*)"', 1) END AS subject FROM {_ANSWER}""")
def json_object_extract(spark, sf):
    j = F.concat(F.lit('{"grade":"'), "role", F.lit('","subject":"'), F.col("turn").cast("string"), F.lit('"}'))
    role = F.col("role")
    a = (
        F.when(role == "user", F.concat(F.lit("Here: ```json\n"), j, F.lit("```"))).when(role == "assistant", F.concat(j, F.lit(" done.")))
        .otherwise(F.replace(j, F.lit('"'), F.lit("")))
    )
    parsed = data.json_object_extract(F.col("a"), "grade string, subject string")
    return table(spark, sf, "conversations").withColumn("a", a).withColumn("p", parsed).select("conv_id", "turn", "p.grade", "p.subject")


@query("merge_metadata", f"""
SELECT chunk_id, md_filename AS filename, CASE WHEN language = 'de' THEN 'German' ELSE md_grade END AS grade, md_subject AS subject, language AS lang FROM {CHUNKS}""")
def merge_metadata(spark, sf):
    right = F.when(F.col("language") == "de", F.create_map(F.lit("grade"), F.lit("German"), F.lit("lang"), F.col("language"))).otherwise(
        F.create_map(F.lit("lang"), F.col("language"))
    )
    m = base.chunks(spark, sf).select("chunk_id", data.merge_metadata(F.col("metadata"), right).alias("m"))
    return m.select("chunk_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("filename", "grade", "subject", "lang")])


@query("append_log", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS n_logs, 'warn' AS level, event_type AS message, ts AS at FROM events""")
def append_log(spark, sf):
    ts = F.col("ts").cast("timestamp")
    first = F.when(F.col("event_type") == "error", data.append_log(F.lit(None), F.lit("start"), "info", ts))
    logs = data.append_log(first, F.col("event_type"), "warn", ts)
    rows = table(spark, sf, "events").withColumn("logs", logs).withColumn("last", F.element_at("logs", -1))
    return rows.select("event_id", F.size("logs").alias("n_logs"), "last.level", "last.message", "last.at")


@query("url_hash", "SELECT page_id, md5(url) AS url_hash, left(base64(encode(url)), 32) AS compat_hash FROM pages")
def url_hash(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.url_hash(u).alias("url_hash"), text.url_hash(u, compat=True).alias("compat_hash"))


@query("build_prompt", f"""
SELECT chunk_id, 'File: ' || md_filename || chr(10) || 'Grades to choose from: a, b' || chr(10) || 'Subjects to choose from: c' || chr(10) ||
  'Answer with one JSON object: grade_name, subject_name, title, language, quality_notes.' || chr(10) || 'Use null for a grade or subject that is not listed or not certain.' || chr(10) ||
  'Text:' || chr(10) || content AS classification,
  'Grade: ' || coalesce(md_grade, 'unknown') || chr(10) || 'Subject: ' || coalesce(md_subject, 'unknown') || chr(10) || 'Title: ' || language || chr(10) || 'Pages: ' ||
  coalesce(CAST(chunk_index AS VARCHAR), '?') || '-?' || chr(10) || 'Flags: ' || CASE WHEN md_grade IS NULL THEN 'none' ELSE md_grade || ', x' END || chr(10) ||
  'Fix scanning damage only and mark added text with generated_content=true.' || chr(10) || 'Original:' || chr(10) || content || chr(10) || 'Current:' || chr(10) || content AS repair,
  'Grade: ' || coalesce(md_grade, 'unknown') || chr(10) || 'Subject: ' || coalesce(md_subject, 'unknown') || chr(10) || 'Write in ' ||
  CASE WHEN regexp_matches(content, '{AR}') THEN 'Arabic' WHEN regexp_matches(content, '(?i)[àâçéèêëîïôùûüœæ]') THEN 'French' ELSE 'the language of the text' END || '.' || chr(10) ||
  'Write 3 questions with answers taken from the text, as JSON {{"pairs":[{{"question":"","answer":""}}]}}.' || chr(10) || 'Text:' || chr(10) || content AS question
FROM {CHUNKS}""")
def build_prompt(spark, sf):
    c = base.chunks(spark, sf)
    grade, subject = [F.try_element_at("metadata", F.lit(k)) for k in ("grade", "subject")]
    content = F.col("content")
    lists = [F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))]
    flags = F.when(grade.isNull(), F.array().cast("array<string>")).otherwise(F.array(grade, F.lit("x")))
    return c.select(
        "chunk_id",
        data.classification_prompt(F.col("metadata")["filename"], content, *lists).alias("classification"),
        data.repair_prompt(grade, subject, F.col("language"), F.col("chunk_index"), F.lit(None).cast("int"), flags, content, content).alias("repair"),
        data.question_prompt(grade, subject, content).alias("question"),
    )


