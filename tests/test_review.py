"""What the review path writes and moves."""

import os

from pyspark.sql import functions as F

from daftar.operators import models
from daftar.plans import review


def test_texts_are_written_once_per_stage(spark):
    """Original texts are stored where they differ only, previews not at all; readers see both texts."""
    def classifier():
        return lambda frame: frame.assign(grade_name="g", subject_name="s", title="", language="fr", quality_notes=[[]] * len(frame))

    text = "\f".join(f"Lesson {i}. " + "A sentence about numbers and letters. " * 40 for i in range(4))
    docs = spark.createDataFrame([(i, f"f{i}.pdf", f"Title of {i}\n{text}") for i in range(3)], "document_id int, filename string, text string")
    names = spark.createDataFrame([("g",), ("s",)], "name string")
    out = review.prepare_corpus(docs, names, names, models.hashing_embedder(8), 8, classifier)
    stored = {os.path.basename(p).rsplit("-", 1)[0]: spark.read.parquet(p) for p in out.paths}
    assert "preview" not in stored["classification"].columns and "original_content" not in stored["drafts"].columns
    for stage in ("scored", "chunks"):
        assert stored[stage].filter("original_content IS NOT NULL").isEmpty()
    assert out.chunks.count() == 12 and out.chunks.filter("NOT original_content <=> content").isEmpty()
    assert {(r["has_grade"], r["has_subject"], r["has_topic"]) for r in out.chunks.collect()} == {(True, True, False)}
    out.close()


def test_repaired_chunks_keep_their_original_text(spark):
    def repairer():
        return lambda frame: frame[["content"]].assign(
            repaired_content=frame["content"] + " Repaired.", detected_language=None, suggested_title=None, quality_score_after=0.9, repair_notes=None, generated_content=False
        )

    docs = spark.createDataFrame([(1, "f.pdf", "A sentence about numbers and letters. " * 20)], "document_id int, filename string, text string")
    names = spark.createDataFrame([("g",)], "name string")
    out = review.prepare_corpus(docs, names, names, models.hashing_embedder(8), 8, repairer=repairer)
    row = out.chunks.select("content", "original_content", F.col("repair_status")).first()
    assert row["content"] == row["original_content"] + " Repaired." and row["repair_status"] == "embedded"
    out.close()
