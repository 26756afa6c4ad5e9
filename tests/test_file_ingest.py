"""Outcomes per file: a broken one neither stops the stream nor is lost, and each file counts once."""

import json

from daftar.streaming import file_ingest


def parser():
    """A function of its own, so that it travels to the workers by value."""
    def parse(path, content):
        return [(r["id"], r["text"]) for r in map(json.loads, content.decode().splitlines())]

    return parse


def put(folder, name, *rows, broken=False):
    folder.mkdir(exist_ok=True)
    text = "\n".join(json.dumps({"id": i, "text": t}) for i, t in rows)
    (folder / name).write_text(text + ("\n{" if broken else ""))


def run(spark, tmp_path, parse=None, **more):
    stream = file_ingest.arriving(spark, str(tmp_path / "in"), "*.json", per_batch=2)
    out = str(tmp_path / "out")
    file_ingest.ingest_files(stream, parse or parser(), "id long, text string", out, str(tmp_path / "ck"), str(tmp_path / "aside"), **more).awaitTermination()
    rows = spark.read.schema("path string, id long, text string").parquet(out + "/rows/*").collect()
    log = spark.read.parquet(out + "/log/*").collect()
    return sorted(r["id"] for r in rows), {r["path"].rsplit("/", 1)[1]: r for r in log}, len(log)


def test_outcomes_over_restarts(spark, tmp_path):
    put(tmp_path / "in", "a.json", (1, "x"), (2, None))
    put(tmp_path / "in", "b.json", (3, "y"), broken=True)
    put(tmp_path / "in", "c.json", (4, "z"))
    put(tmp_path / "in", "none.json")
    put(tmp_path / "in", "left.txt", (9, "not asked for"))
    ids, log, n = run(spark, tmp_path)
    assert ids == [1, 2, 4] and n == 3  # Spark passes over the file without a byte
    assert {k: (r["status"], r["n_rows"], r["attempts"]) for k, r in log.items()} == {
        "a.json": ("done", 2, 1), "b.json": ("error", 0, 3), "c.json": ("done", 1, 1)}
    assert log["b.json"]["error"].startswith("JSONDecodeError")
    assert not (tmp_path / "in" / "b.json").exists()
    assert [p.name.split("-", 1)[1] for p in (tmp_path / "aside").iterdir() if not p.name.startswith(".")] == ["b.json"]
    put(tmp_path / "in", "d.json", (5, "new"))
    ids, log, n = run(spark, tmp_path)  # a restart takes the new file only
    assert ids == [1, 2, 4, 5] and n == 4


def test_a_passing_failure_is_tried_again(spark, tmp_path):
    mark = str(tmp_path / "once")

    def flaky(path, content):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("not yet")
        return [(1, "t")]

    put(tmp_path / "in", "a.json", (1, "x"))
    ids, log, _ = run(spark, tmp_path, flaky)
    assert ids == [1] and (log["a.json"]["status"], log["a.json"]["attempts"]) == ("done", 2)
