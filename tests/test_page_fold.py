"""The page fold: segments as functions, and any cut against the fold in one piece."""

import random

import pytest

from daftar.operators.page_fold import FULL_CHUNK, JOINT, MAX_CHUNK, SegmentFunction, fold_pages, page_mark

SCHEMA = "document_id int, page_number int, text string, low_text boolean, ocr_detected boolean"


def plain_fold(pages, length=0):
    """(chunks begun or closed here, open length at the end) of [(number, low, block lengths)]."""
    closed, begun = 0, []
    for number, low, lengths in pages:
        for place, n in enumerate(lengths or [len(page_mark(number))]):
            if length and lengths and length + len(JOINT) + n > MAX_CHUNK:
                closed, length = closed + 1, 0
            if not length:
                begun.append((number, place))
            length = length + len(JOINT) + n if length else n
        if lengths and (low or length >= FULL_CHUNK):
            closed, length = closed + 1, 0
    return closed, begun, length


def some_pages(rnd, count, first=1):
    kinds = [[], [3], [12, 40], [150] * 4, [700], [1100], [500, 900, 1300], [2600], [2100, 90]]
    return [(first + i, rnd.random() < 0.1, rnd.choice(kinds)) for i in range(count)]


@pytest.mark.parametrize("seed", range(8))
def test_segment_function_tells_every_entry(seed):
    rnd = random.Random(seed)
    pages = some_pages(rnd, rnd.choice([1, 2, 5, 30]), 41)
    function = SegmentFunction(pages[0][0])
    for page in pages:
        function.page(*page)
    rows = list(function.rows())
    for entry in [*range(0, 2600, 7), 1, 1199, 1200, 2199, 2200, 9000]:
        hits = [r for r in rows if r[0] <= entry <= r[1]]
        assert len(hits) == 1
        _, _, fixed, out, closed, page, block, _ = hits[0]
        want_closed, begun, length = plain_fold(pages, entry)
        assert (closed, out if fixed else entry + out) == (want_closed, length)
        assert (page, block) == (begun[0] if begun else (None, None))


def as_rows(docs):
    """Blocks of the asked lengths; a letter per block shows lost or moved ones."""
    rows = []
    for doc, pages in docs.items():
        for i, (number, low, lengths) in enumerate(pages):
            text = "\n\n".join(chr(97 + (i + j) % 26) * n for j, n in enumerate(lengths))
            rows.append((doc, number, text if lengths or i % 2 else None, low, i % 5 == 0))
    return rows


def plain_chunks(rows):
    """The chunks by a loop over one document's pages after the other."""
    out, open_ = [], {}

    def close(doc, end):
        out.append((doc, open_["index"], JOINT.join(open_["parts"]), open_["start"], end, open_["ocr"]))
        open_.update(index=open_["index"] + 1, parts=[], ocr=False)

    for doc in sorted({r[0] for r in rows}):
        open_.update(index=0, parts=[], ocr=False)
        for _, number, text, low, ocr in sorted(r for r in rows if r[0] == doc):
            blocks = [b for b in (text or "").split("\n\n") if b]
            for block in blocks or [page_mark(number)]:
                if blocks and open_["parts"] and len(JOINT.join([*open_["parts"], block])) > MAX_CHUNK:
                    close(doc, number)
                if not open_["parts"]:
                    open_["start"] = number
                open_["parts"].append(block)
                open_["ocr"] = open_["ocr"] or ocr
            if blocks and (low or len(JOINT.join(open_["parts"])) >= FULL_CHUNK):
                close(doc, number)
        if open_["parts"]:
            close(doc, number)
    return sorted(out)


@pytest.mark.parametrize("width", [1, 2, 7, 1000])
def test_any_cut_gives_the_same_chunks(spark, width):
    rnd = random.Random(width)
    docs = {d: some_pages(rnd, 60) for d in range(4)}
    docs[4] = [(n, False, []) for n in range(1, 50)]  # empty pages alone: one long chunk
    docs[5] = [(n, False, [330]) for n in range(1, 90)]  # blocks that never end a page in a full chunk's place
    docs[6] = [(n * 3 + 5, False, [1100, 1150]) for n in range(20)]  # gaps in numbers, closes within pages
    rows = as_rows(docs)
    got = fold_pages(spark.createDataFrame(rows, SCHEMA).repartition(5), width).collect()
    assert sorted(map(tuple, got)) == plain_chunks(rows)


def test_a_document_without_borders_is_split(spark):
    rows = [(1, n, "w" * 700, False, False) for n in range(1, 400)]
    from daftar.operators import page_fold

    groups = page_fold._grouped(spark.createDataFrame(rows, SCHEMA), 20).groupBy("_group").count().collect()
    assert len(groups) == 20 and max(r["count"] for r in groups) <= 24


def test_no_pages(spark):
    assert fold_pages(spark.createDataFrame([], SCHEMA)).collect() == []
