"""Stages around injected model functions.

A model function takes a pandas DataFrame of its inputs and returns one of its
outputs, row for row.  Only the input columns travel to Python; each task calls
the factory once, so a model is loaded once per task.  A failing batch is retried
row by row, and a failing row reports its error instead of stopping the job.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.functions import data, names
from daftar.functions.text import clamp_score, generated_content, js_trim
from daftar.operators.filters import choice_key

ModelFn = Callable[[pd.DataFrame], pd.DataFrame]
MIN_REPAIRED = 0.5
DEFAULT_REPAIR_SCORE = 0.8
ERROR_CHARS = 400


def _call(fn: ModelFn, frame: pd.DataFrame, fields: list[str]) -> pd.DataFrame:
    """The model's outputs and ``error``; a failing batch is asked again row by row."""
    try:
        if len(frame) == 1:
            return pd.DataFrame([_call_row(fn, frame.iloc[:], fields)], columns=[*fields, "error"], dtype=object)
        out = fn(frame)[fields].reset_index(drop=True)
        if len(out) != len(frame):
            raise ValueError(f"model returned {len(out)} rows for {len(frame)}")
        return out.assign(error=None)
    except Exception:  # the model is foreign code
        rows = [_call_row(fn, frame.iloc[i:i + 1], fields) for i in range(len(frame))]
        return pd.DataFrame(rows, columns=[*fields, "error"], dtype=object)


def _call_row(fn: ModelFn, row: pd.DataFrame, fields: list[str]) -> list:
    """The outputs and the error of one row, without a frame of their own."""
    row.index = pd.RangeIndex(1)
    try:
        out = fn(row)
        if not all(f in out for f in fields):
            out = out[fields]
        if len(out) != 1:
            raise ValueError(f"model returned {len(out)} rows for 1")
        return [*(out[f].tolist()[0] for f in fields), None]
    except Exception as exc:
        return [None] * len(fields) + [str(exc)[:ERROR_CHARS]]


def _in_batches(fn: ModelFn, frame: pd.DataFrame, fields: list[str], batch: int) -> pd.DataFrame:
    parts = [_call(fn, frame.iloc[i:i + batch].reset_index(drop=True), fields) for i in range(0, len(frame), batch)]
    return pd.concat(parts, ignore_index=True).astype(object) if parts else pd.DataFrame(columns=[*fields, "error"])


def _model_udf(run, out_type: T.DataType):
    run.__annotations__ = {"frames": Iterator[pd.DataFrame], "return": Iterator[pd.Series if isinstance(out_type, T.ArrayType) else pd.DataFrame]}
    return F.pandas_udf(run, out_type).asNondeterministic()


def model_column(factory: Callable[[], ModelFn], inputs: list[Column], schema: str, batch: int = 32) -> Column:
    """Struct column of the model's outputs plus ``error``."""
    out_type = T.StructType.fromDDL(f"{schema}, error string")
    fields = [f.name for f in out_type.fields[:-1]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for frame in frames:
            yield _in_batches(fn, frame, fields, batch)

    return _model_udf(run, out_type)(F.struct(*inputs))


def model_lists(factory: Callable[[], ModelFn], inputs: list[Column], output: str, batch: int = 32) -> Column:
    """One output string per element of the input lists, null where the model failed.

    The lists of a row, which are of one length, are its pieces; the model sees
    pieces of several rows together.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        fn = factory()
        for frame in frames:
            sizes = [0 if v is None else len(v) for v in frame.iloc[:, 0]]
            flat = pd.DataFrame({c: [x for v in frame[c] if v is not None for x in v] for c in frame.columns})
            got = _in_batches(fn, flat, [output], batch)[output].tolist()
            ends = np.cumsum(sizes)
            yield pd.Series([got[e - n:e] for e, n in zip(ends, sizes)], dtype=object)

    return _model_udf(run, T.ArrayType(T.StringType()))(F.struct(*inputs))


# --- embedding ---------------------------------------------------------------

def hashing_embedder(dim: int = 64) -> Callable[[], ModelFn]:
    """Offline stand-in for an embedding model: signed hashed word counts, unit length."""

    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(frame), dim))
        for i, text in enumerate(frame["text"]):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode("utf-8"))
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.DataFrame({"embedding": list(np.divide(out, norm, out=out, where=norm > 0).astype("float32"))})

    return lambda: fn


def embed_text(df: DataFrame, factory: Callable[[], ModelFn], text: Column, dim: int, output: str = "embedding") -> DataFrame:
    """Adds the vector of ``text`` and ``embedding_error``; a wrong length is an error."""
    out = model_column(factory, [text.alias("text")], "embedding array<float>")
    df = df.withColumn("_m", out)
    got = F.size("_m.embedding")
    wrong = F.concat(F.lit("expected "), F.lit(str(dim)), F.lit(" dimensions, got "), F.greatest(got, F.lit(0)).cast("string"))
    error = F.coalesce("_m.error", F.when(F.col("_m.embedding").isNull() | (got != dim), wrong))
    return df.withColumn("embedding_error", error).withColumn(
        output, F.when(F.col("embedding_error").isNull(), F.col("_m.embedding"))
    ).drop("_m")


def embed_chunks(eligible: DataFrame, factory: Callable[[], ModelFn], dim: int, model: str = "hashing", prefix: str = "passage: ") -> DataFrame:
    """Vectors for eligible chunks, with the status that follows from success or failure."""
    text = F.concat(F.lit(prefix), F.col("content"))
    base = eligible.drop("embedding", "embedding_status", "embedding_model")
    out = embed_text(base, factory, text, dim)
    ok = F.col("embedding_error").isNull()
    return out.withColumns({
        "embedding_status": F.when(ok, "done").otherwise("failed"),
        "repair_status": F.when(ok, "embedded").otherwise("embedding_failed"),
        "embedding_model": F.when(ok, model),
        "is_processed": ok,
    })


# --- classification ----------------------------------------------------------

def classify_by_filename(docs: DataFrame) -> DataFrame:
    """Deterministic classification of ``docs(document_id, filename)`` from the file name."""
    named = docs.withColumn("_name", names.normalise_filename(F.col("filename")))
    named = named.withColumn("_slug", names.detect_grade_slug(F.col("_name")))
    name = F.col("_name")
    return named.select(
        *docs.columns,
        names.grade_label_of(F.col("_slug")).alias("grade_name"),
        F.lit(None).cast("string").alias("subject_name"),
        names.cleanup_topic(name, F.col("_slug")).alias("title"),
        names.detect_language(name).alias("language"),
        F.array().cast("array<string>").alias("quality_notes"),
    )


CLASS_SCHEMA = "grade_name string, subject_name string, title string, language string, quality_notes array<string>"


def classify_documents(docs: DataFrame, factory: Callable[[], ModelFn] | None, grades: DataFrame, subjects: DataFrame, exact: bool = True) -> DataFrame:
    """Classification of ``docs(document_id, filename, preview)``.

    Grade and subject are kept only when they are on the lists ``grades(name)``
    and ``subjects(name)``; a failed call leaves nulls and a note.  Without a
    model the file name decides.
    """
    if factory is None:
        out = classify_by_filename(docs)
    else:
        m = model_column(factory, [F.col("filename"), F.col("preview")], CLASS_SCHEMA)
        note = F.array(F.concat(F.lit("classification_failed:"), F.col("_m.error")))
        fields = [F.col(f"_m.{c}").alias(c) for c in ("grade_name", "subject_name", "title", "language")]
        notes = F.when(F.col("_m.error").isNotNull(), note).otherwise(F.coalesce("_m.quality_notes", F.array().cast("array<string>")))
        out = docs.withColumn("_m", m).select(*docs.columns, *fields, notes.alias("quality_notes"))
    fold = (lambda c: c) if exact else choice_key
    for column, dim in (("grade_name", grades), ("subject_name", subjects)):
        allowed = dim.select(fold(F.col("name")).alias("_ok")).distinct()
        out = out.join(allowed, fold(F.col(column)) == F.col("_ok"), "left")
        out = out.withColumn(column, F.when(F.col("_ok").isNotNull(), F.col(column))).drop("_ok")
    return out


# --- repair --------------------------------------------------------------------

REPAIR_SCHEMA = (
    "repaired_content string, detected_language string, suggested_title string,"
    " quality_score_after double, repair_notes array<string>, generated_content boolean"
)


def call_repair(chunks: DataFrame, factory: Callable[[], ModelFn]) -> DataFrame:
    """Model answers for the chunks that need review, in ``repair`` (a struct).

    The model sees the chunk's text, title, flags, grade, subject and pages, and
    the prompt made of them; what the chunks lack is null.
    """
    kinds = {"grade_name": "string", "subject_name": "string", "page_start": "int", "page_end": "int"}
    given = {c: F.col(c) if c in chunks.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()}
    content = F.col("content")
    original = F.coalesce(F.nullif("original_content", F.lit("")), content)
    prompt = data.repair_prompt(*[given[c] for c in ("grade_name", "subject_name")], F.col("title"), *[given[c] for c in ("page_start", "page_end")], F.col("flags"), original, content)
    inputs = [content, *[F.col(c) for c in ("original_content", "title", "flags")], *given.values(), prompt.alias("prompt")]
    return chunks.filter(F.col("repair_status") == "needs_review").withColumn(
        "repair", model_column(factory, inputs, REPAIR_SCHEMA)
    )


def gate_repairs(answered: DataFrame) -> DataFrame:
    """What a model answer does to its chunk.

    An empty answer keeps the text, a missing score counts 0.8, a score under 0.5
    rejects the chunk, an error leaves it unchanged and is reported in
    ``repair_error``.
    """
    r = F.col("repair")
    failed = r["error"].isNotNull()
    text = F.coalesce(F.nullif(js_trim(r["repaired_content"]), F.lit("")), F.col("content"))
    score = clamp_score(F.coalesce(r["quality_score_after"], F.lit(DEFAULT_REPAIR_SCORE)))
    invented = F.coalesce(r["generated_content"], F.lit(False)) | generated_content(
        F.coalesce(F.nullif("original_content", F.lit("")), "content"), text
    )
    return answered.withColumns({
        "repaired_content": F.when(failed, F.col("content")).otherwise(text),
        "quality_score_after": F.when(~failed, score),
        "generated_content": F.when(failed, False).otherwise(invented),
        "repair_status": F.when(failed, F.col("repair_status")).when(score < MIN_REPAIRED, "rejected").otherwise("auto_repaired"),
        "title": F.coalesce(r["suggested_title"], "title"),
        "language": F.coalesce(r["detected_language"], "language"),
        "repair_notes": r["repair_notes"] if "repair_notes" in answered.schema["repair"].dataType.names else F.lit(None).cast("array<string>"),
        "repair_error": r["error"],
    }).drop("repair")


def repair_chunks(chunks: DataFrame, factory: Callable[[], ModelFn]) -> DataFrame:
    """The repaired rows; apply them with ``apply_edits``."""
    return gate_repairs(call_repair(chunks, factory))


# --- formatting ------------------------------------------------------------------

FORMAT_PIECE, FORMAT_MIN = 3000, 50
FORMATTED_SUBJECTS = [names.MATHS, names.ISLAMIC]


def format_documents(docs: DataFrame, factory: Callable[[], ModelFn], key: str = "document_id", text: str = "text") -> DataFrame:
    """Reformat mathematics and Islamic education texts, whole, in pieces a prompt can hold.

    Pieces stay lists inside the row, so no text is shuffled; texts of other
    subjects never go near the model.  A short answer keeps its piece.
    """
    asked = F.coalesce(F.col("subject_hint").isin(*FORMATTED_SUBJECTS) & (F.length(text) > 0), F.lit(False))
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / FORMAT_PIECE).cast("int"))
    cut = docs.filter(asked).withColumn("_pieces", F.transform(starts, lambda i: F.substring(F.col(text), i * FORMAT_PIECE + 1, F.lit(FORMAT_PIECE))))
    prompts = F.transform("_pieces", lambda p: data.format_prompt(F.col("subject_hint"), p))
    answered = cut.withColumn("_answers", model_lists(factory, [prompts.alias("prompt"), F.col("_pieces").alias("piece_text")], "formatted"))
    parts = F.zip_with("_pieces", "_answers", lambda p, a: F.when(F.length(a) > FORMAT_MIN, js_trim(a)).otherwise(p))
    done = answered.withColumn(text, F.array_join(parts, "")).select(*docs.columns)
    return done.unionByName(docs.filter(~asked))


# --- questions --------------------------------------------------------------------

PAIRS_SCHEMA = "pairs array<struct<question:string,answer:string>>"
MIN_QA_CHARS = 5


def qa_ready(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.col("embedding_status") == "done") & ~F.coalesce("qa_generated", F.lit(False)))


def extract_pairs(answers: DataFrame, answer: str = "answer_text") -> DataFrame:
    """Question and answer rows out of model answers; short ones are dropped."""
    parsed = data.json_object_extract(F.col(answer), PAIRS_SCHEMA)
    rows = answers.withColumn("_p", parsed["pairs"]).select(
        *[c for c in answers.columns if c != answer], F.posexplode("_p").alias("pair_index", "_pair")
    )
    out = rows.withColumn("question", js_trim(F.col("_pair.question"))).withColumn("answer", js_trim(F.col("_pair.answer")))
    return out.filter((F.length("question") > MIN_QA_CHARS) & (F.length("answer") > MIN_QA_CHARS)).drop("_pair")


def generate_qa(chunks: DataFrame, factory: Callable[[], ModelFn], n: int = 3) -> tuple[DataFrame, DataFrame]:
    """Question rows, and the chunk ids done (also those that gave no pair).

    A chunk whose call failed is in neither and comes up again.
    """
    from daftar.session import durable

    prompt = data.question_prompt(F.col("grade"), F.col("subject"), F.col("content"), n)
    out = model_column(factory, [prompt.alias("prompt"), F.col("content")], "answer_text string")
    answered = qa_ready(chunks).select("chunk_id", "grade_id", out.alias("m"))
    answered = durable(answered.select("chunk_id", "grade_id", "m.answer_text", "m.error"), "qa")
    ok = answered.filter(F.col("error").isNull())
    return extract_pairs(ok.select("chunk_id", "grade_id", "answer_text")), ok.select("chunk_id")
