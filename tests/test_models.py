"""Model stages, edits, plans and stores."""

import pandas as pd
from pyspark.sql import functions as F

from daftar.operators import aliases, curriculum, edit, filters, models
from daftar.plans import ingest, review
from daftar.sources import files, hash_index, links, stores


def test_embed_reports_failures_per_row(spark):
    def factory():
        def fn(frame):
            if frame["text"].str.contains("bad").any():
                raise ValueError("x" * 900)
            return pd.DataFrame({"embedding": [[1.0, 2.0]] * len(frame)})
        return fn

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "chunk_id int, content string")
    rows = {r.chunk_id: r for r in models.embed_chunks(df, factory, 2, prefix="").collect()}
    assert rows[1].embedding_status == "done" and rows[3].repair_status == "embedded"
    assert rows[2].embedding_status == "failed" and len(rows[2].embedding_error) == 400 and rows[2].embedding is None


def test_embed_checks_dimension(spark):
    df = spark.createDataFrame([(1, "a")], "chunk_id int, content string")
    r = models.embed_chunks(df, models.hashing_embedder(8), 16).collect()[0]
    assert r.repair_status == "embedding_failed" and r.embedding_error == "expected 16 dimensions, got 8"


def test_classify_keeps_only_listed_values(spark):
    def factory():
        def fn(frame):
            if (frame["filename"] == "boom.pdf").any():
                raise ValueError("no answer")
            n = len(frame)
            return pd.DataFrame({"grade_name": ["G"] * n, "subject_name": ["other"] * n, "title": ["T"] * n, "language": ["fr"] * n, "quality_notes": [["ok"]] * n})
        return fn

    docs = spark.createDataFrame([(1, "a.pdf", "x"), (2, "boom.pdf", "x")], "document_id int, filename string, preview string")
    grades, subjects = spark.createDataFrame([("G",)], "name string"), spark.createDataFrame([("S",)], "name string")
    rows = {r.document_id: r for r in models.classify_documents(docs, factory, grades, subjects).collect()}
    assert (rows[1].grade_name, rows[1].subject_name, rows[1].quality_notes) == ("G", None, ["ok"])
    assert (rows[2].grade_name, rows[2].title, rows[2].quality_notes) == (None, None, ["classification_failed:no answer"])


def test_generate_qa(spark):
    def factory():
        def fn(frame):
            def answer(t):
                if t == "fail":
                    raise ValueError("down")
                return "nothing" if t == "none" else '```json\n{"pairs":[{"question":"What is it?","answer":" A fraction. "},{"question":"Why","answer":"too short"}]}\n```'
            return pd.DataFrame({"answer_text": [answer(t) for t in frame["content"]]})
        return fn

    rows = [(1, "text", "done", False), (2, "none", "done", False), (3, "fail", "done", False), (4, "text", "pending", False), (5, "text", "done", True)]
    df = spark.createDataFrame(rows, "chunk_id int, content string, embedding_status string, qa_generated boolean")
    df = df.withColumns({"grade_id": F.lit("g"), "grade": F.lit(None).cast("string"), "subject": F.lit(None).cast("string")})
    pairs, done = models.generate_qa(df, factory)
    assert [(r.chunk_id, r.question, r.answer) for r in pairs.collect()] == [(1, "What is it?", "A fraction.")]
    assert sorted(r.chunk_id for r in done.collect()) == [1, 2]


def test_format_keeps_the_whole_text(spark):
    from daftar.functions.names import MATHS

    text = "e" * 7000 + "tail"
    docs = spark.createDataFrame([(1, text, MATHS), (2, "e", "x"), (3, "short e", MATHS)], "document_id int, text string, subject_hint string")
    factory = lambda: (lambda f: pd.DataFrame({"formatted": f["piece_text"].str.replace("e", "E")}))
    got = {r.document_id: r.text for r in models.format_documents(docs, factory).collect()}
    assert got == {1: "E" * 7000 + "tail", 2: "e", 3: "short e"}


def test_allowed_choice_and_empty_list(spark):
    df = spark.createDataFrame([("mathematiques",), ("History",), (None,), ("",)], "v string")
    names = spark.createDataFrame([("MathEmatiques ",), ("Physics",)], "name string")
    assert [r.v for r in filters.allowed_choice(df, "v", names, "name").collect()] == ["mathematiques"]
    assert sorted(r.v for r in filters.allowed_choice(df, "v", names.limit(0), "name").collect()) == ["History", "mathematiques"]


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, "x" * 60), (3, "short")], "id int, content string")
    assert [r.id for r in edit.conditional_delete(df, edit.broken_content()).collect()] == [2]
    assert [r.id for r in edit.conditional_delete(df, F.length("content") < 50).orderBy("id").collect()] == [1, 2]


def test_file_states(spark, tmp_path):
    for name in ("a.pdf", "sub/b.done.pdf", "sub/c.error.pdf", "note.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"%PDF")
    inv = files.file_inventory(spark, str(tmp_path))
    assert {(r.filename, r.status, r.file_size) for r in inv.collect()} == {("a.pdf", "pending", 4), ("b.done.pdf", "done", 4), ("c.error.pdf", "error", 4)}
    assert "content" not in inv._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert tuple(files.inventory_counts(inv).collect()[0]) == (3, 1, 1, 1)


def test_links(spark):
    html = '<a class="x" href="/f/one.pdf?x=1">One <b>file</b></a><a href=\'two.PDF\'>Two</a><a href="/page">no</a><a href="//cdn.org/three.pdf">3</a>'
    pages = spark.createDataFrame([(1, "https://s.org/dir/index.html?q=1", html), (2, "https://s.org/", '<a href="/f/one.pdf?x=1">again</a>')], "page_id int, url string, html string")
    got = {r.pdf_url: (r.filename, r.detected_title) for r in links.link_discovery(pages).collect()}
    assert got == {
        "https://s.org/f/one.pdf?x=1": ("one.pdf", "One file"), "https://s.org/dir/two.PDF": ("two.PDF", "Two"), "https://cdn.org/three.pdf": ("three.pdf", "3"),
    }


def test_upsert_prefers_newer(spark):
    store = spark.createDataFrame([("a", 1, 1), ("b", 1, 5)], "k string, v int, version int")
    new = spark.createDataFrame([("a", 2, 2), ("b", 2, 3), ("c", 2, 1)], "k string, v int, version int")
    got = {r.k: r.v for r in stores.upsert(new, store, ["k"], [F.col("version").desc()]).collect()}
    assert got == {"a": 2, "b": 1, "c": 2}


def test_bac_grade_takes_the_section_branch(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    nodes = curriculum.curriculum_nodes(
        df([("curr-1", "Test Curriculum")], "curriculum_id string, name string"), df([("cycle-1", "Secondary", "curr-1")], "cycle_id string, name string, curriculum_id string"),
        df([("grade-bac", "البكالوريا", "cycle-1")], "grade_id string, name string, cycle_id string"), df([], "grade_id string, subject_id string"),
        df([], "subject_id string, name string"), df([("sec-1", "Sciences")], "section_id string, name string"),
        df([("track-1", "PC", "sec-1")], "track_id string, name string, section_id string"), df([], "track_id string, subject_id string"),
    )
    got = {r.path: (r.type, r.n_children) for r in nodes.collect()}
    root = "curr-1/cycle-1/grade-bac"
    assert got[root] == ("grade", 1) and got[root + "/sec-1"] == ("section", 1) and got[root + "/sec-1/track-1"] == ("track", 0)


def test_prepare_corpus_with_models(spark):
    page = "Les fractions sont des nombres rationnels que nous utilisons souvent en classe. " * 20
    docs = spark.createDataFrame(
        [(1, "cours-fractions-1ac.pdf", page + "\f" + "court"), (2, "x.pdf", "l e s aaaaaaaaaaaa ------")], "document_id int, filename string, text string"
    )
    grades, subjects = spark.createDataFrame([("الأولى إعدادي",)], "name string"), spark.createDataFrame([("S",)], "name string")

    def repairer():
        def fn(f):
            n = len(f)
            return pd.DataFrame({"repaired_content": f["content"] + " repaired", "detected_language": ["fr"] * n, "suggested_title": [None] * n,
                                 "quality_score_after": [0.9] * n, "repair_notes": [[]] * n, "generated_content": [False] * n})
        return fn

    out = review.prepare_corpus(docs, grades, subjects, models.hashing_embedder(16), 16, repairer=repairer)
    rows = {(r.document_id, r.chunk_index): r for r in out.chunks.collect()}
    assert rows[1, 0].repair_status == "embedded" and rows[1, 0].content.endswith("repaired") and len(rows[1, 0].embedding) == 16
    assert rows[2, 0].repair_status == "rejected" and rows[2, 0].embedding is None and not rows[2, 0].is_active
    assert out.versions.count() == sum(r.content.endswith("repaired") for r in rows.values())
    assert {r.document_id: r.extraction_mode for r in out.documents.collect()} == {1: "hybrid", 2: "scanned"}
    assert out.logs.count() == 4
    # what the writes observed is what a recount finds
    told = {(r.stage, r.counter): r.value for r in review.metrics_table(spark, out).collect()}
    assert told["pages", "rows"] == 3 and told["chunks", "rows"] == len(rows) == told["scored", "rows"]
    assert told["chunks", "embedded"] == told["chunks", "vectors"] == sum(r.embedding is not None for r in rows.values())
    assert told["repairs", "failed"] == 0 and told["chunks", "rejected"] == sum(r.repair_status == "rejected" for r in rows.values())


def test_stage_counts_cost_no_further_job(spark):
    """Counting while writing runs the jobs that writing runs, also for an empty stage."""
    from daftar.session import durable

    def jobs(**more):
        group = f"observed-{len(more)}"
        spark.sparkContext.setJobGroup(group, group)
        durable(spark.range(1000), "numbers", **more)
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    told = {}
    assert jobs(counts={"rows": F.count("*"), "even": F.count_if(F.col("id") % 2 == 0)}, told=told) == jobs()
    assert told == {"numbers": {"rows": 1000, "even": 500}}
    durable(spark.range(0), "none", {"rows": F.count("*")}, told)
    assert told["none"] == {"rows": 0}


def test_ingest_twice_adds_nothing(spark, tmp_path):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    dims = ingest.Dimensions(
        df([("g", "1ère année Bac", "c")], "grade_id string, name string, cycle_id string"), df([("c", "u")], "cycle_id string, curriculum_id string"),
        df([("s", "Mathématiques")], "subject_id string, name string"), df([("t", "Nombres", "s", "g")], "topic_id string, title string, subject_id string, grade_id string"),
        aliases.alias_index(aliases.default_aliases(spark)),
    )
    text = "Les nombres entiers forment un ensemble. " * 60
    new = df([(1, "unit-1bac-math.pdf", text), (2, "copy-1bac-math.pdf", text), (3, "tiny.pdf", "x")], "file_id int, filename string, text string")
    store = df([], "content_hash string, metadata map<string,string>")
    rows, counters = ingest.ingest_corpus(new, store, dims, models.hashing_embedder(8), 8)
    got = rows.collect()
    assert {(r.source_id, r.subject_id, r.grade_id, r.curriculum_id) for r in got} == {("t", "s", "g", "u")}
    counts = {r.filename: (r.inserted, r.skipped) for r in counters.collect()}
    assert sum(a for a, _ in counts.values()) == len(got) == sum(b for _, b in counts.values())
    again, _ = ingest.ingest_corpus(new, rows.select("content_hash", "metadata"), dims, models.hashing_embedder(8), 8)
    assert again.count() == 0
    hashes = str(tmp_path / "hashes")
    hash_index.create(rows, hashes)
    again, _ = ingest.ingest_corpus(new, store, dims, models.hashing_embedder(8), 8, hashes=hashes)
    assert again.count() == 0


def test_review_leaves_no_tables(spark):
    import os

    from daftar.plans import review

    docs = spark.createDataFrame([(1, "1ac.pdf", "Les fractions sont des nombres. " * 20), (2, "x.pdf", "court")], "document_id int, filename string, text string")
    names = spark.createDataFrame([("English",)], "name string")
    done = review.prepare_corpus(docs, names, names, models.hashing_embedder(8), 8, keep_newlines=True)
    assert done.chunks.count() > 0 and done.logs.count() >= 2
    paths = list(done.paths)
    assert len(paths) >= 3 and all(os.path.isdir(p.removeprefix("file:")) for p in paths)
    done.close()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_failing_batch_makes_no_frame_per_row(monkeypatch):
    asked = []

    def fn(frame):
        asked.append((len(frame), list(frame.index)))
        if (frame["x"] == 3).any():
            raise ValueError("three")
        return pd.DataFrame({"y": frame["x"] * 1.5, "z": [["a"]] * len(frame)})

    monkeypatch.setattr(models.pd, "concat", lambda *a, **k: 1 / 0)
    out = models._call(fn, pd.DataFrame({"x": [1, 2, 3, 4]}), ["y", "z"])
    assert out["y"].tolist() == [1.5, 3.0, None, 6.0] and out["z"].tolist() == [["a"], ["a"], None, ["a"]]
    assert out["error"].tolist() == [None, None, "three", None]
    assert asked == [(4, [0, 1, 2, 3])] + [(1, [0])] * 4
    assert models._call(fn, pd.DataFrame({"x": [3]}), ["y", "z"])["error"].tolist() == ["three"] and len(asked) == 6
