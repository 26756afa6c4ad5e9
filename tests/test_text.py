"""Golden values of the scalar text functions."""

import random

import pytest
from pyspark.sql import functions as F

from daftar.functions import data, text


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("c"))).collect()]


def test_normalize(spark):
    got = values(spark, text.normalize_content, ["  hello  ", "a\t\t b", "a\r\nb", "a\n\n\n\nb", " x　"])
    assert got == ["hello", "a b", "a\nb", "a\n\nb", "x"]


def test_hash_ignores_spacing(spark):
    a, b = values(spark, text.content_hash, ["a  b", "a b"])
    assert a == b and len(a) == 32


def test_wash_drops_nul(spark):
    assert values(spark, text.wash_text, [" a\0b "]) == ["ab"]


@pytest.mark.parametrize("raw,want", [(-0.5, 0.0), (1.5, 1.0), (0.12345, 0.123), (float("nan"), 0.0), (float("inf"), 0.0), (None, 0.0)])
def test_clamp(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v double")
    assert df.select(text.clamp_score(F.col("v"))).collect()[0][0] == want


def test_noise(spark):
    got = values(spark, text.repeated_noise, ["aaaaaaaa", "aaaaaaa", "x ------ y", "normal text."])
    assert got == [True, False, True, False]


def test_broken_spacing(spark):
    got = values(spark, text.broken_spacing, ["v i t", "د ر س", "La lumière traverse le verre", "الضوء ينتشر بسرعة", "éa b c"])
    # The ASCII boundary before the "a" of "éa" counts as one.
    assert got == [True, True, False, False, True]


def test_boolean_filter(spark):
    assert values(spark, text.to_boolean_filter, ["true", "false", "yes", "1", None]) == [True, False, None, None, None]


def test_generated_content(spark):
    rows = [("the quick brown fox", "the quick brown fox."), ("short text", "short text with many entirely new invented words here"), ("a", "")]
    df = spark.createDataFrame(rows, "o string, r string")
    got = [r[0] for r in df.select(text.generated_content(F.col("o"), F.col("r"))).collect()]
    assert got == [False, True, False]


def test_segment_type(spark):
    pad = " mot" * 30
    got = values(spark, text.segment_type, ["Le volcan", "Définition: " + pad, "Exercice: " + pad, "exemple" + pad, "تعريف " + pad, "Une phrase" + pad])
    assert got == ["title", "definition", "exercise", "example", "paragraph", "paragraph"]
    aware = values(spark, lambda c: text.segment_type(c, True), ["تعريف " + pad])
    assert aware == ["definition"]


def test_detect_title(spark):
    inputs = ["Le volcan\nIl crache", "3 / 4\nx", "~~~\nx", "Oz\nx", "b" * 121 + "\nx", "طبقات الأرض\nx"]
    got = values(spark, lambda c: text.detect_title(c, F.lit("fallback")), inputs)
    assert got == ["Le volcan"] + ["fallback"] * 5
    assert values(spark, lambda c: text.detect_title(c, F.lit("f"), True), inputs[-1:]) == ["طبقات الأرض"]


def test_safe_filename(spark):
    got = values(spark, text.safe_filename, ["/a/b/c%20d?.pdf", "درس 1.pdf", "100%.pdf"])
    assert got == ["c d_.pdf", "درس 1.pdf", "100_.pdf"]


def test_url_hash_compat_collides(spark):
    a, b = values(spark, lambda c: text.url_hash(c, compat=True), ["https://example.com/aaaa/1", "https://example.com/aaaa/2"])
    assert a == b
    c, d = values(spark, text.url_hash, ["https://example.com/aaaa/1", "https://example.com/aaaa/2"])
    assert c != d


def test_cosine(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0]), ([], [1.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [round(r[0], 9) for r in df.select(data.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]


def test_parse_vector(spark):
    got = values(spark, data.parse_vector, ["[1, 2.5]", "1, 2", "[1, x, 3]", "", None, "abc"])
    assert got == [[1.0, 2.5], [1.0, 2.0], [1.0, 3.0], [], [], []]


def test_json_object(spark):
    raw = ['```json\n{"grade":"A","subject":"B"}\n```', 'text {"grade":"A"} tail', "none", "{broken"]
    fn = lambda c: data.json_object_extract(c, "grade string, subject string")
    got = values(spark, fn, raw)
    assert [(r.grade, r.subject) if r else None for r in got] == [("A", "B"), ("A", None), None, None]


def test_merge_and_log(spark):
    df = spark.range(1).select(
        data.merge_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"),
        data.merge_metadata(F.lit(None).cast("map<string,string>"), F.create_map(F.lit("x"), F.lit("y"))).alias("n"),
        data.append_log(F.lit(None), F.lit("hi"), "info", F.current_timestamp()).alias("l"),
    )
    r = df.collect()[0]
    assert r.m == {"a": "1", "b": "3"} and r.n == {"x": "y"} and [x.message for x in r.l] == ["hi"]


def test_faster_text_rules_are_the_plain_rules(spark):
    """Against the plain patterns, on random strings of spaces of all kinds, letters and symbols."""
    draw = random.Random(5)
    marks = "ab Z9_éاب#-\t\n\r\x0b\x1c\x85  ᠎ ​  　﻿\U0001f600"
    texts = ["".join(draw.choices(draw.sample(marks, draw.randint(2, 6)), k=draw.randint(0, 14))) for _ in range(6_000)]
    t, w = F.col("t"), "[A-Za-z0-9_]"
    ar = r"[\x{0600}-\x{06FF}]"
    noise = t.rlike(r"(.)\1{7,}") | t.rlike(rf"[^\p{{L}}\p{{N}}{text.WS_IN}]{{6,}}")
    spaced = t.rlike(rf"(?<!{w})[a-zA-Z]{text.WS}+[a-zA-Z]{text.WS}+[a-zA-Z](?!{w})") | t.rlike(f"{ar}{text.WS}+{ar}{text.WS}+{ar}")
    blanks = text.js_trim(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))
    pairs = [(text.repeated_noise(t), noise), (text.broken_spacing(t), spaced), (text.clean_text(t), blanks)]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    assert rows.filter(noise).count() > 50 and rows.filter(spaced).count() > 50
    for got, want in pairs:
        assert rows.filter(got != want).isEmpty()
