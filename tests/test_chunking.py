"""Chunkers and the quality score."""

import random

import pytest
from pyspark.sql import functions as F

from daftar.functions.text import content_hash
from daftar.operators import chunking, quality

WORDS = "le la les fraction nombre entier cellule énergie موجة ضوء معادلة".split()


def long_text(seed, words, sep=" "):
    rnd = random.Random(seed)
    out = []
    for i in range(words):
        out.append(rnd.choice(WORDS) + rnd.choice(["", "", "", ".", "?", "؟", "\n\n" if sep == " " else ""]))
    return sep.join(out)


@pytest.mark.parametrize("seed", range(6))
def test_window_invariants(seed):
    text = long_text(seed, 1500).strip()
    cuts = list(chunking.window_cuts(text))
    assert all(100 <= len(c) <= 1200 for _, c in cuts)
    assert cuts[0][0] == 0 and text.endswith(cuts[-1][1][-50:])
    for (s1, c1), (s2, _) in zip(cuts, cuts[1:]):
        assert s1 < s2 <= s1 + 1200 and s2 <= s1 + 1200 - 200 + 1
        assert text[s1:].lstrip().startswith(c1[:20])


def test_window_terminates_on_short_text():
    assert list(chunking.window_cuts("x" * 150)) == [(0, "x" * 150)]
    assert list(chunking.window_cuts("")) == []


def paragraph_twin(text, size, overlap, min_len):
    """From each begin, the farthest unit end that fits, found by trying all."""
    units = list(chunking.paragraph_units(text, size))
    canvas = "\n\n".join(units)
    ends = [len("\n\n".join(units[: i + 1])) for i in range(len(units))]
    begins = [e - len(u) for e, u in zip(ends, units)]
    spans, i, start = [], 0, None
    while i < len(units):
        start = begins[i] if start is None else start
        fitting = [j for j in range(i, len(units)) if ends[j] - start <= size]
        if fitting:
            i, end = fitting[-1] + 1, ends[fitting[-1]]
            spans.append((start, end))
            tail = canvas[max(start, end - overlap):end].lstrip()
            start = end - len(tail) if tail and i < len(units) and ends[i] - begins[i] <= size else None
            continue
        end = ends[i]
        while end - start > size:
            breaks = [c + 1 for c in range(start + int(0.55 * size), start + size) if canvas[c].isspace()]
            cut = breaks[-1] if breaks else start + size
            spans.append((start, cut))
            start = end - len(canvas[cut - overlap:end].lstrip())
        spans.append((start, end))
        i, start = i + 1, None
    return [p for p in (canvas[a:b].strip() for a, b in spans) if len(p) >= min_len]


@pytest.mark.parametrize("size,overlap,min_len", [(1200, 200, 100), (200, 40, 20), (90, 0, 1), (60, 30, 1)])
@pytest.mark.parametrize("seed", range(4))
def test_paragraphs_against_the_farthest_end(seed, size, overlap, min_len):
    rnd = random.Random(seed)
    text = "\n\n".join(long_text(rnd.random(), rnd.choice([1, 5, 30, 300]), rnd.choice([" ", ""])) for _ in range(25))
    got = [p for _, p in chunking.paragraph_cuts(text, size, overlap, min_len)]
    assert got == paragraph_twin(text, size, overlap, min_len)
    assert all(min_len <= len(p) <= size for p in got)


def test_paragraph_units():
    assert list(chunking.paragraph_units(" un\tdeux \n \u00a0\n\n trois\nquatre ")) == ["un deux", "trois quatre"]
    assert list(chunking.paragraph_units("Aa bb. Cc dd? Ee: ff", 13)) == ["Aa bb. Cc dd?", "Ee: ff"]
    assert list(chunking.paragraph_units("")) == []


def test_a_long_unit_takes_nothing_over():
    text = "a" * 40 + "\n\n" + "b" * 130 + "\n\n" + "c" * 30
    assert [p for _, p in chunking.paragraph_cuts(text, 100, 20, 1)] == ["a" * 40, "b" * 100, "b" * 50, "c" * 30]


def test_a_full_chunk_hands_on_its_end():
    text = "ab " * 15 + "\n\n" + "c" * 50
    assert [p for _, p in chunking.paragraph_cuts(text, 80, 10, 1)] == [("ab " * 15).strip(), "b ab ab ab\n\n" + "c" * 50]
    with pytest.raises(ValueError):
        list(chunking.paragraph_cuts(text, 80, 44))


def test_fixed_covers_text(spark):
    text = "abcdefghij" * 330
    rows = chunking.chunk_fixed(spark.createDataFrame([(1, text)], "k int, text string"), "k").orderBy("window_index").collect()
    assert [r.content for r in rows] == [text[i * 1000:i * 1000 + 1200] for i in range(len(rows))]
    assert rows[-1].content.endswith(text[-10:])


def page_rows(spark, docs):
    rows = [
        (d, i + 1, t, len(t), len(t) < 40, ocr)
        for d, pages in docs.items() for i, (t, ocr) in enumerate(pages)
    ]
    return spark.createDataFrame(rows, "document_id int, page_number int, text string, extracted_text_length int, low_text boolean, ocr_detected boolean")


def classes(spark, ids, title="Plants and light"):
    return spark.createDataFrame([(i, title, "fr") for i in ids], "document_id int, title string, language string")


def test_pages_titles_and_flags(spark):
    docs = {
        1: [("La photosynthèse\nLes feuilles captent la lumière et produisent du sucre.", True)],
        2: [("2024 / 7\nthe first line has no letter, so the document gives the title", False)],
        3: [("x" * 900 + "\n\n" + "y" * 900 + "\n\n" + "z" * 900, False)],
        4: [("", False), ("", False), ("Text of the third page which is long enough to be kept.", False)],
    }
    out = chunking.chunk_pages(page_rows(spark, docs), classes(spark, docs)).collect()
    by = {(r.document_id, r.chunk_index): r for r in out}
    assert by[1, 0].title == "La photosynthèse" and by[1, 0].ocr_detected
    assert by[2, 0].title == "Plants and light"
    assert len([k for k in by if k[0] == 3]) == 2
    assert by[4, 0].content.startswith("[Page 1]\n\n[Page 2]\n\nText") and (by[4, 0].page_start, by[4, 0].page_end) == (1, 3)


def test_overflow_reports_next_page_as_end(spark):
    docs = {1: [("a" * 1100, False), ("b" * 1150, False)]}
    out = chunking.chunk_pages(page_rows(spark, docs), classes(spark, docs)).orderBy("chunk_index").collect()
    assert [(r.page_start, r.page_end, len(r.content)) for r in out] == [(1, 2, 1100), (2, 2, 1150)]


@pytest.mark.parametrize("giant", [1, 3, 7, 50])
def test_giant_documents_split_without_change(spark, giant):
    rnd = random.Random(3)
    docs = {d: [("m" * rnd.choice([0, 10, 60, 300, 700, 1300, 2500]), rnd.random() < 0.2) for _ in range(40)] for d in (1, 2)}
    pages = page_rows(spark, docs)
    cols = ["document_id", "chunk_index", "content", "page_start", "page_end", "ocr_detected"]
    whole = chunking.chunk_pages(pages, classes(spark, docs)).select(*cols)
    cut = chunking.chunk_pages(pages.repartition(5), classes(spark, docs), giant_pages=giant).select(*cols)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


CLEAN = "Une cellule végétale possède une paroi rigide et une grande vacuole. " * 3


def scored(spark, **changes):
    row = dict(content=CLEAN, title="La cellule végétale", ocr_detected=False, is_duplicate=False, has_grade=True, has_subject=True, has_topic=True)
    row |= changes
    schema = "content string, title string, ocr_detected boolean, is_duplicate boolean, has_grade boolean, has_subject boolean, has_topic boolean"
    return quality.score_chunks(spark.createDataFrame([tuple(row.values())], schema)).collect()[0]


UNPLACED = dict(title="", has_grade=False, has_subject=False, has_topic=False)
# One departure from a clean chunk each: the flags it gets, and what the penalty table leaves of 100 points.
DEPARTURES = [
    ({}, [], 100),
    ({"content": CLEAN[:119].rstrip()}, ["too_short"], 75),
    ({"content": CLEAN * 13}, ["too_long"], 80),
    ({"content": "7.5 / 12 = 0,625 ; " * 9}, ["low_alpha_density"], None),
    ({"content": CLEAN + "z" * 8}, ["ocr_noise"], 80),
    ({"title": ""}, ["missing_title"], 90),
    ({"title": "§ 4"}, ["poor_title_quality"], 90),
    ({"has_grade": False}, ["missing_grade"], 90),
    ({"has_subject": False}, ["missing_subject"], 90),
    ({"has_topic": False}, ["missing_topic"], 90),
    ({"ocr_detected": True}, ["ocr_detected"], 92),
    ({"is_duplicate": True}, ["duplicate"], 60),
    ({"has_topic": False, "ocr_detected": True}, ["missing_topic", "ocr_detected"], 82),
]


@pytest.mark.parametrize("changes,flags,points", DEPARTURES)
def test_each_penalty(spark, changes, flags, points):
    r = scored(spark, **changes)
    if points is None:  # the flags beside the first are the text's own
        assert flags[0] in r.flags
    else:
        assert (r.flags, round(100 * r.quality_score)) == (flags, points)
        assert r.repair_status == ("duplicate" if "duplicate" in flags else "needs_review" if flags else "clean")


@pytest.mark.parametrize("content", ["", "\n", "\u3000 \t"])
def test_no_content_is_rejected(spark, content):
    r = scored(spark, content=content)
    assert (r.flags, r.quality_score, r.repair_status) == (["empty_content"], 0, "rejected")


def test_below_threshold_is_rejected(spark):
    r = scored(spark, content="Trop court.", **UNPLACED)  # 100 - 25 - 4 * 10 = 35
    assert r.flags[-1] == "below_quality_threshold" and r.repair_status == "rejected" and r.quality_score == 0.35


def test_no_letter_and_no_digit_teaches_nothing(spark):
    assert "low_educational_value" in scored(spark, content="... ~ ... ; " * 12).flags


def test_score_at_threshold_is_kept(spark):
    # 100 - 25 - 20 - 10 = 45 hundredths: kept, although 0.45 is the limit.
    r = scored(spark, content="Texte court avec bruit ------ dedans et des lettres.", title=None)
    assert r.quality_score == 0.45 and r.repair_status == "needs_review"


def test_hash_matches_md5_of_utf8(spark):
    import hashlib

    df = spark.createDataFrame([("é ا",)], "c string")
    assert df.select(content_hash(F.col("c"))).collect()[0][0] == hashlib.md5("é ا".encode()).hexdigest()
