"""Needles in texts against brute force, with needles that begin alike, several automata and hot texts."""

import itertools

import pytest

from daftar.operators import patterns, resolve


def found(spark, needles, texts, per_automaton):
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    return sorted(tuple(r) for r in patterns.contained_in(n, "n", t, "t", per_automaton).collect())


@pytest.mark.parametrize("per_automaton", [50_000, 7])
def test_against_brute_force(spark, per_automaton):
    needles = ["".join(x) for k in (1, 2, 3) for x in itertools.product("aب ", repeat=k)] + ["", None, "aab", "zz"]
    texts = ["aabab", "a", "ب ب a", "", None, "bcd", "aab" * 40, "😀a😀"]
    want = sorted((n, t) for n in set(needles) - {"", None} for t in set(texts) - {"", None} if n in t)
    assert found(spark, needles, texts, per_automaton) == want


def test_needles_that_begin_alike_and_repeated_texts(spark):
    """A third of all needles and texts share their beginning; nothing is copied per beginning."""
    needles = [f"lesson {i}" for i in range(400)] + ["lesson"]
    texts = [f"the lesson {i} of lesson" for i in range(100)] + ["the lesson 5 of lesson"] * 500
    want = sorted({(n, t) for n in needles for t in texts if n in t})
    assert found(spark, needles, texts, 100) == want


def test_rows_of_both_sides_stay_whole(spark):
    n = spark.createDataFrame([("ab", 1), ("ab", 2), ("x", 3), (None, 4)], "n string, g int")
    t = spark.createDataFrame([("cabc", 1, 10), ("cabc", 2, 11), ("ab", None, 12)], "t string, h int, id int")
    from pyspark.sql import functions as F

    got = resolve.containment_join(n, "n", t, "t", F.col("h").isNull() | (F.col("g") == F.col("h")))
    assert sorted(map(tuple, got.select("n", "g", "id").collect())) == [("ab", 1, 10), ("ab", 1, 12), ("ab", 2, 11), ("ab", 2, 12)]


def test_texts_are_read_once(spark, capsys):
    n, t = spark.createDataFrame([("ab",)], "n string"), spark.createDataFrame([("cabc",)], "t string")
    patterns.contained_in(n, "n", t, "t").explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("MapInPandas") == 1
