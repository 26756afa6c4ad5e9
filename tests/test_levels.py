"""The levelled table: few runs open, any retry harmless, the same rows as one big upsert."""

import math

from pyspark.sql import functions as F

from daftar.streaming import flows, levels

KEY = ["k"]


def batch_rows(spark, n):
    return spark.range(5).select((F.col("id") * 7 + n * 3).alias("i")).select((F.col("i") % 40).alias("k"), ((F.col("i") * 5 + n) % 11).alias("v"), F.lit(n).alias("n"))


def newest(n):
    """By loop: the larger v stays, of equal ones the later batch."""
    out = {}
    for b in range(n):
        best = {}
        for i in range(5):
            j = i * 7 + b * 3
            best[j % 40] = max(best.get(j % 40, (-1, b)), ((j * 5 + b) % 11, b))
        for k, row in best.items():
            out[k] = max(out.get(k, (-1, -1)), row)
    return out


def test_names_of_merged_runs():
    assert [levels.merged_run(b, 4) for b in (0, 2, 3, 7, 15, 63)] == [None, None, (0, 3), (4, 7), (0, 15), (0, 63)]
    assert levels.live([(0, 15), (0, 3), (3, 3), (16, 19), (16, 16), (20, 20)]) == [(0, 15), (16, 19), (20, 20)]


def test_a_hundred_batches(spark, tmp_path):
    path, fan, by = str(tmp_path / "t"), 4, [F.col("v").desc()]
    for b in range(100):
        levels.write_batch(batch_rows(spark, b).coalesce(1), path, b, KEY, by, fan)
        opened = len(levels.live(levels.runs(spark, path)))
        assert opened <= (fan - 1) * (1 + math.floor(math.log(b + 1, fan)))
        if b in (4, 15, 16, 63):  # a repeated batch changes nothing
            before = levels.runs(spark, path)
            levels.write_batch(batch_rows(spark, b).coalesce(1), path, b, KEY, by, fan)
            assert levels.runs(spark, path) == before
    assert len(levels.runs(spark, path)) < 20  # covered runs are deleted
    got = {r["k"]: (r["v"], r["n"]) for r in levels.read(spark, path, KEY, by).collect()}
    assert got == newest(100)


def test_an_unfinished_merge_does_not_count(spark, tmp_path):
    path, by = str(tmp_path / "t"), [F.col("v").desc()]
    for b in range(4):
        levels.write_batch(batch_rows(spark, b), path, b, KEY, by, 4)
    (tmp_path / "t" / "0-3" / "_SUCCESS").unlink()  # its writer died
    assert levels.live(levels.runs(spark, path)) == [(b, b) for b in range(4)]
    want = newest(4)
    assert {r["k"]: (r["v"], r["n"]) for r in levels.read(spark, path, KEY, by).collect()} == want
    levels.write_batch(batch_rows(spark, 3), path, 3, KEY, by, 4)
    assert levels.live(levels.runs(spark, path)) == [(0, 3)]
    assert {r["k"]: (r["v"], r["n"]) for r in levels.read(spark, path, KEY, by).collect()} == want


def test_from_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for b in range(5):
        batch_rows(spark, b).coalesce(1).write.mode("append").parquet(source)
        stream = flows.table_stream(spark, source, "*.parquet")
        levels.stream_upsert(stream, path, str(tmp_path / "ck"), KEY, [F.col("v").desc()], fan=2).awaitTermination()
    assert {r["k"]: (r["v"], r["n"]) for r in levels.read(spark, path, KEY, [F.col("v").desc()]).collect()} == newest(5)
    assert levels.live(levels.runs(spark, path)) == [(0, 3), (4, 4)]
