"""Vectors, JSON payloads, metadata maps, logs and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.functions.names import prompt_language
from daftar.functions.text import js_trim, let


def _doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths or a zero norm."""
    na, nb = norm(a), norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na != 0) & (nb != 0)
    return F.when(usable, dot(a, b) / (na * nb)).otherwise(0.0)


def parse_vector(c: Column) -> Column:
    """JSON text or a bare comma list to finite doubles; anything else to ``[]``."""
    text = js_trim(c)
    parsed = F.from_json(text, "array<double>")
    bare = F.split(F.regexp_replace(text, r"^\[|\]$", ""), ",")
    loose = F.transform(bare, lambda p: js_trim(p).try_cast("double"))
    values = F.coalesce(parsed, loose)
    inf = F.lit(float("inf"))
    keep = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<double>")).otherwise(keep)


def json_object_text(c: Column) -> Column:
    """The outermost ``{...}`` of a model answer, code fences removed."""
    plain = js_trim(F.replace(F.replace(c, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when(inner == "", plain).otherwise(inner)


def json_object_extract(c: Column, schema: str) -> Column:
    """Parsed object; null when the answer holds no valid JSON object."""
    text = json_object_text(c)
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema))


def merge_metadata(left: Column, right: Column) -> Column:
    """Shallow merge of two maps; the right one wins, null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    both = F.struct(F.coalesce(left, empty).alias("a"), F.coalesce(right, empty).alias("b"))
    return let(both, lambda v: F.map_concat(F.map_filter(v["a"], lambda k, _: ~F.map_contains_key(v["b"], k)), v["b"]))


def metadata_null(c: Column, key: str, json: bool = False) -> Column:
    """Key missing, or holding the word ``null``."""
    v = F.get_json_object(c, f"$.{key}") if json else F.try_element_at(c, F.lit(key))
    return v.isNull() | (v == "null")


LOG_TYPE = "array<struct<message:string,level:string,at:timestamp>>"


def append_log(logs: Column, message: Column, level: str, at: Column) -> Column:
    entry = F.struct(
        message.cast("string").alias("message"),
        F.lit(level).alias("level"),
        at.cast("timestamp").alias("at"),
    )
    return F.concat(F.coalesce(logs, F.array().cast(LOG_TYPE)), F.array(entry))


def _known(c: Column, absent: str = "unknown") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(absent))


def classification_prompt(filename: Column, preview: Column, grades: Column, subjects: Column) -> Column:
    """Ask for grade, subject, title and language out of closed lists."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), filename),
        F.concat(F.lit("Grades to choose from: "), F.array_join(grades, ", ")),
        F.concat(F.lit("Subjects to choose from: "), F.array_join(subjects, ", ")),
        F.lit("Answer with one JSON object: grade_name, subject_name, title, language, quality_notes."),
        F.lit("Use null for a grade or subject that is not listed or not certain."),
        F.concat(F.lit("Text:\n"), preview),
    )


def repair_prompt(grade, subject, title, page_start, page_end, flags, original, current) -> Column:
    pages = F.concat(_known(page_start.cast("string"), "?"), F.lit("-"), _known(page_end.cast("string"), "?"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Grade: "), _known(grade)),
        F.concat(F.lit("Subject: "), _known(subject)),
        F.concat(F.lit("Title: "), _known(title)),
        F.concat(F.lit("Pages: "), pages),
        F.concat(F.lit("Flags: "), _known(F.array_join(flags, ", "), "none")),
        F.lit("Fix scanning damage only and mark added text with generated_content=true."),
        F.concat(F.lit("Original:\n"), original),
        F.concat(F.lit("Current:\n"), current),
    )


def format_prompt(subject: Column, text: Column) -> Column:
    """Formatting instruction for the two subjects that need one; null otherwise."""
    from daftar.functions.names import ISLAMIC, MATHS

    maths = "Format this mathematics text: write formulas as LaTeX between $ signs, change nothing else.\n"
    verses = "Format this religious text: enclose verses in ﴾ ﴿ and keep all vowel marks, change nothing else.\n"
    return F.when(subject == MATHS, F.concat(F.lit(maths), text)).when(
        subject == ISLAMIC, F.concat(F.lit(verses), text)
    )


def question_prompt(grade: Column, subject: Column, content: Column, n: int = 3) -> Column:
    language = F.coalesce(prompt_language(content), F.lit("the language of the text"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Grade: "), _known(grade)),
        F.concat(F.lit("Subject: "), _known(subject)),
        F.concat(F.lit("Write in "), language, F.lit(".")),
        F.lit(f'Write {n} questions with answers taken from the text, as JSON {{"pairs":[{{"question":"","answer":""}}]}}.'),
        F.concat(F.lit("Text:\n"), content),
    )
