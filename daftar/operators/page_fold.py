"""Carrying text blocks over page ends into chunks, by a fold that can be cut at any page.

The fold's state is the open chunk, and only its length decides what happens next.  So a
segment of pages is a function of that length: up to the first close it depends on the length
it was entered with, behind it on the place of that close alone.  ``SegmentFunction`` tabulates
it in one pass over block lengths, and a scan over a document's segments composes the functions.
This tells where in each segment the first chunk begins.  Texts are then cut there, and every
group folds from an empty state, in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import WS, normalize_content
from daftar.session import durable

# A chunk is closed before it exceeds MAX_CHUNK characters, and
# after a page that leaves it with at least FULL_CHUNK.
MAX_CHUNK, FULL_CHUNK = 2200, 1200
JOINT = "\n\n"
# Documents with more pages than this are folded in several groups.
GIANT_PAGES = 100_000
_ANY = 2**62

_BORDER = "_segment long, _page int, _block int, _over boolean, _index long, _open long"
_CASE = "_segment long, low long, high long, fixed boolean, out long, closed long, _page int, _block int, _over boolean"
_DRAFT = "chunk_index int, content string, page_start int, page_end int, ocr_detected boolean"


def page_blocks(pages: DataFrame) -> DataFrame:
    """Adds ``_blocks``: the cleaned text blocks of each page; none for an empty or null text."""
    cut = r"(?:\r?\n){2,}|(?<=\.)" + WS + r"{2,}|(?<=\x{061F})" + WS + "+"
    blocks = F.transform(F.split("text", cut), lambda b: normalize_content(b))
    return pages.withColumn("_blocks", F.coalesce(F.filter(blocks, lambda b: b != ""), F.array().cast("array<string>")))


def page_mark(number: int) -> str:
    """What an empty page adds."""
    return f"[Page {number}]"


class SegmentFunction:
    """Length of the open chunk at the begin of a segment -> length at its end, closes, first chunk begun.

    ``cases`` hold ranges of entry lengths that share their first close.  Cases
    whose open chunks have become equally long go on as one.
    """

    def __init__(self, first_page: int):
        self.cases = [[0, 0, (first_page, 0, False)]]
        self.live = {0: [(0, 0)]}  # open length -> [(case, chunks closed)]
        self.high, self.added = _ANY, 0  # entry lengths 1 to high have met no close yet
        self.behind: list[int] = []  # cases that closed at the last page's end

    def _close(self, least: int, length: int, start: tuple | None) -> None:
        least = max(least, 1)
        if least <= self.high:
            self.live.setdefault(length, []).append((len(self.cases), 1))
            if start is None:
                self.behind.append(len(self.cases))
            self.cases.append([least, self.high, start])
            self.high = least - 1

    def _move(self, closes, to) -> None:
        moved: dict[int, list] = {}
        for length, members in self.live.items():
            if closes(length):
                members = [(case, closed + 1) for case, closed in members]
            moved.setdefault(to(length), []).extend(members)
        self.live = moved

    def page(self, number: int, low: bool, lengths: list[int]) -> None:
        for case in self.behind:
            self.cases[case][2] = (number, 0, False)
        self.behind = []
        if not lengths:
            n = len(page_mark(number))
            self._move(lambda _: False, lambda c: c + len(JOINT) + n if c else n)
            self.added += len(JOINT) + n
            return
        for block, n in enumerate(lengths):
            room = MAX_CHUNK - len(JOINT) - n
            self._move(lambda c: c and c > room, lambda c: c + len(JOINT) + n if 0 < c <= room else n)
            self._close(room - self.added + 1, n, (number, block, True))
            self.added += len(JOINT) + n
        full = 1 if low else FULL_CHUNK
        self._move(lambda c: c >= full, lambda c: 0 if c >= full else c)
        self._close(full - self.added, 0, None)

    def rows(self) -> Iterator[tuple]:
        for length, members in self.live.items():
            for case, closed in members:
                low, high, start = self.cases[case]
                yield low, high, True, length, closed, *(start or (None, None, None))
        if self.high >= 1:
            yield 1, self.high, False, self.added, 0, None, None, None


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _table(rows: list[tuple], key: pa.DataType, like: pa.Schema) -> pa.RecordBatch:
    schema = pa.schema([pa.field("document_id", key), *like])
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(name, _ARROW[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def segment_cases(pages: DataFrame, width: int) -> DataFrame:
    """The function of each segment of ``width`` pages, as rows; only lengths leave the scan."""
    key = pages.schema["document_id"].dataType.simpleString()
    ready = (
        page_blocks(pages)
        .select("document_id", F.floor((F.col("page_number") - 1) / width).cast("long").alias("_segment"),
                "page_number", "low_text", F.transform("_blocks", F.length).alias("_lengths"))
        .repartition("document_id", "_segment")
        .sortWithinPartitions("document_id", "_segment", "page_number")
    )
    like = _schema(_CASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, function = None, None
        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            for doc, segment, page, low, lengths in _columns(batch):
                if who != (doc, segment):
                    done += [(*who, *r) for r in function.rows()] if who else []
                    who, function = (doc, segment), SegmentFunction(page)
                function.page(page, bool(low), lengths)
            yield _table(done, kind, like)
        if who:
            yield _table([(*who, *r) for r in function.rows()], kind, like)

    return ready.mapInArrow(run, f"document_id {key}, {_CASE}")


def compose(cases: DataFrame) -> DataFrame:
    """Borders: the first chunk begun in each segment, its index, and the group open before it.

    A scan over a few rows per segment that keeps two numbers.
    """
    key = cases.schema["document_id"].dataType.simpleString()
    ready = cases.repartition("document_id").sortWithinPartitions("document_id", "_segment", "low")
    like = _schema(_BORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = segment = group = None
        first, entry, length, index = True, 0, 0, 0
        for batch in batches:
            found = []
            for d, s, low, high, fixed, out, closed, page, block, over in _columns(batch):
                if first or d != doc:
                    first, doc, segment, group, length, index = False, d, None, None, 0, 0
                if s != segment:
                    segment, entry = s, length
                if low <= entry <= high:
                    found.append((doc, segment, page, block, over, index + (entry > 0), group))
                    length, index = out if fixed else entry + out, index + closed
                    group = group if page is None else segment
            yield _table(found, batch.schema.field(0).type, like)

    return ready.mapInArrow(run, f"document_id {key}, {_BORDER}")


def _grouped(pages: DataFrame, width: int) -> DataFrame:
    """Adds ``_blocks``, ``_group`` and ``_index``, the number of the group's first chunk.

    A page within which the border lies becomes two rows.  If its first block
    closes the chunk before it, the row without blocks (null) tells that group
    the page's number.
    """
    beyond = pages.filter(F.col("page_number") > width).select("document_id").filter("document_id IS NOT NULL").distinct()
    whole = page_blocks(pages).withColumn("_group", F.lit(0).cast("long")).withColumn("_index", F.lit(0).cast("long"))
    if beyond.isEmpty():
        return whole
    giants = pages.join(durable(beyond, "giants"), "document_id", "left_semi")
    borders = durable(compose(segment_cases(giants, width)), "borders").withColumnRenamed("document_id", "_doc")
    segment = F.floor((F.col("page_number") - 1) / width)
    met = whole.drop("_group", "_index").join(borders, (F.col("document_id") == F.col("_doc")) & (segment == F.col("_segment")), "left")

    def part(group, blocks):
        return F.struct(F.coalesce(group, F.lit(0)).alias("_group"), F.coalesce("_index", F.lit(0)).alias("_index"), blocks.alias("_blocks"))

    blocks, place = F.col("_blocks"), F.col("_page")
    before = F.when(F.col("_block") > 0, F.slice("_blocks", F.lit(1), F.col("_block")))
    behind = F.slice("_blocks", F.col("_block") + 1, F.size("_blocks"))
    parts = (
        F.when((F.col("page_number") == place) & F.col("_over"), F.array(part(F.col("_open"), before), part(F.col("_segment"), behind)))
        .when(F.col("page_number") >= place, F.array(part(F.col("_segment"), blocks)))
        .otherwise(F.array(part(F.col("_open"), blocks)))
    )
    kept = [c for c in pages.columns if c != "text"]
    return met.select(*kept, F.inline(parts))


def fold_pages(pages: DataFrame, width: int = GIANT_PAGES) -> DataFrame:
    """(document_id, chunk_index, content, page_start, page_end, ocr_detected) of all documents.

    ``pages(document_id, page_number, text, low_text, ocr_detected)`` has a page number
    once per document.  Texts cross one shuffle; of documents over ``width`` pages, block
    lengths cross another one before.  ``pages`` should be a stored table: the search for
    such documents then reads page numbers only, and row-group statistics skip most of them.
    """
    key = pages.schema["document_id"].dataType.simpleString()
    ready = (
        _grouped(pages, width)
        .select("document_id", "_group", "_index", "page_number", "low_text", "ocr_detected", "_blocks")
        .repartition("document_id", "_group")
        .sortWithinPartitions("document_id", "_group", "page_number")
    )
    like = _schema(_DRAFT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, kind = None, None
        parts: list[str] = []
        length = start = last = index = 0
        marked = False
        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            for doc, group, first, page, low, ocr, blocks in _columns(batch):
                if who != (doc, group):
                    if parts:
                        done.append((who[0], index, JOINT.join(parts), start, last, marked))
                    who, index = (doc, group), first
                    parts, length, marked = [], 0, False
                last = page
                if blocks is None:
                    continue
                for block in blocks or [page_mark(page)]:
                    if parts and blocks and length + len(JOINT) + len(block) > MAX_CHUNK:
                        done.append((doc, index, JOINT.join(parts), start, page, marked))
                        index, parts, length, marked = index + 1, [], 0, False
                    if not parts:
                        start = page
                    length += len(block) + (len(JOINT) if parts else 0)
                    parts.append(block)
                    marked = marked or bool(ocr)
                if parts and blocks and (low or length >= FULL_CHUNK):
                    done.append((doc, index, JOINT.join(parts), start, page, marked))
                    index, parts, length, marked = index + 1, [], 0, False
            yield _table(done, kind, like)
        if parts:
            yield _table([(who[0], index, JOINT.join(parts), start, last, marked)], kind, like)

    return ready.mapInArrow(run, f"document_id {key}, {_DRAFT}")
