"""Packing token pieces into fixed windows by non-negative least squares.

Documents become token ids; each is cut into full windows and a rest, a piece
each.  How pieces share windows is planned on their length histogram alone, which
has at most ``window`` rows however many documents there are:

1. enumerate the *mixes*: combinations of at most ``DEPTH`` lengths (in steps of
   the grid) that fill a window;
2. find by non-negative least squares how often to repeat each mix so that the
   histogram is used up;
3. round the repeat counts down to whole numbers that the histogram can serve;
4. pack what is left greedily, longest first, again on the histogram: one
   pattern of lengths is built, repeated as often as its lengths last, and so on.

Pieces are then numbered within their length class, in hash-split groups with
prefix sums, and a piece's number says which window it goes to.

Nulls and edge cases: a null or empty text is a document of the end mark alone; a
null ``doc_id`` is an id like any other, repeated rows are packed each; ties in
length are numbered by id, start and checksum; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.common import KEPT, durable, give_back, tokenizer_file

WINDOW = 2048
#: Pieces in an enumerated mix at most.
DEPTH = 3
#: Length classes at most; the grid is the window divided by this.
CLASSES = 256
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words in each of a worker's two generations of remembered words.
REMEMBERED = 400_000
#: Rows of a length class that are numbered in one group, on average.
GROUP = 50_000


class WordTokenizer:
    """Ids of texts as little-endian bytes, remembering words.

    The vocabulary drops white space and never merges across it, so the ids of a
    text are those of its words in a row; words repeat far more than texts do.
    A word of Latin letters with a final mark is looked up as word and mark; its
    letters are lower-cased here and need no normaliser and no pattern, so a
    tokenizer of the same merges without these steps gives their ids.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # A task has one core: threads for all cores of the machine cost CPU time, and memory that each holds on to.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.inner = Tokenizer.from_file(file)
        self.plain = Tokenizer(self.inner.model)
        cut, to_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([cut, to_bytes])
        vocabulary = self.inner.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_plain(self, words: list[str]) -> None:
        if not words:
            return
        lines = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
        ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()  # the vocabulary marks a word's last id
        data, known, a = ids.tobytes(), self.known, 0
        for w, b in zip(words, ends, strict=True):
            known[w] = data[a:b]
            a = b

    def _learn(self, words: set[str]) -> None:
        """Ids of new words; those asked for since the last turn-over are kept longer."""
        if not words:
            return
        known, older = self.known, self.older
        if older:
            again = words & older.keys()
            for w in again:
                known[w] = older[w]
            words = words - again
        parts = [(w, m[1], m[2]) for w in words if (m := _PLAIN(w))]
        stems = {s.lower() for _, s, _ in parts}.difference(known)
        for w in stems & older.keys():
            known[w] = older[w]
            stems.discard(w)
        self._encode_plain(list(stems))
        for mark in ".,;:!?":
            if mark not in known:
                known[mark] = np.array(self.inner.encode(mark, add_special_tokens=False).ids, "<u4").tobytes()
        for w, s, m in parts:
            known[w] = known[s.lower()] + known[m] if m else known[s.lower()]
        rest = [w for w in words if w not in known]
        for w, e in zip(rest, self.inner.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; words that are new to them are looked up together."""
        if len(self.known) > REMEMBERED:  # a new generation; what it needs of the old one is taken over
            self.older, self.known = self.known, {}
        cut = [_words(p) for p in pieces]
        self._learn(set(chain.from_iterable(cut)).difference(self.known))
        return [b"".join(map(self.known.__getitem__, ws)) for ws in cut]

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order; texts of any length are read in pieces."""
        now, ids = 0, []
        for group in _grouped(texts):
            for i, got in zip([i for i, _ in group], self._ids([p for _, p in group])):
                while now < i:
                    yield b"".join(ids)
                    now, ids = now + 1, []
                ids.append(got)
        for _ in range(now, len(texts)):
            yield b"".join(ids)
            ids = []


#: Characters of text that are cut into words at once.
PIECE = 500_000
_SPACES = re.compile(r"[\x20\x09-\x0D]")


def _grouped(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Texts, or pieces of long ones that end at white space, with their numbers, in groups of about PIECE characters."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            found = _SPACES.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = found.start() if found else len(text)
            group.append((i, text[at:end]))
            size += end - at
            if size >= PIECE:
                yield group
                group, size = [], 0
            if not found:
                break
            at = end
    if group:
        yield group


#: Letters below U+0130, which lower-case by themselves and are composed already, and a mark.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([.,;:!?]?)").fullmatch
@functools.lru_cache(maxsize=1)
def _word_tokenizer(file: str) -> WordTokenizer:
    """One per worker process, whatever number of tasks it runs."""
    return WordTokenizer(file)


KEPT.append(_word_tokenizer.cache_clear)


def _words(text: str) -> list[str]:
    """Cut at white space: Python's kind, without the four separators that the vocabulary keeps."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return re.split(r"[\x20\x09-\x0D]+", text)
    return text.split()


def token_pieces(docs: DataFrame, window: int = WINDOW, end: int = END, tokenizer: str = TOKENIZER, with_ids: bool = True) -> DataFrame:
    """Pieces of the documents: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    mark = np.array([end], "<u4").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        words = _word_tokenizer(tokenizer_file(tokenizer))
        for batch in rows:
            cols: list[list] = [[] for _ in range(6)]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), words.many(texts)):
                ids += mark
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    got = (doc, at, len(piece) // 4, zlib.crc32(piece), n, np.frombuffer(piece, "<i4") if with_ids else None)
                    for col, value in zip(cols, got):
                        col.append(value)
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, [p.split()[0] for p in kind.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


# --- the plan, on the histogram ---------------------------------------------------


def mixes(units: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with at most ``depth`` parts, largest first."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, most: int, parts: tuple[int, ...]) -> None:
        if not rest:
            out.append(parts)
        elif len(parts) < depth:
            # the remaining parts must be able to reach the sum
            for p in range(min(rest, most), -(-rest // (depth - len(parts))) - 1, -1):
                grow(rest - p, p, (*parts, p))

    grow(units, units, ())
    return out


def non_negative(cols: list[tuple[int, ...]], want: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Least squares with non-negative unknowns: accelerated projected gradient on the sparse system."""
    row = np.concatenate([np.array(c) for c in cols])
    col = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    times = lambda x: np.bincount(row, x[col], len(want))
    back = lambda r: np.bincount(col, r[row], len(cols))
    v = np.ones(len(cols))
    for _ in range(30):  # largest eigenvalue, for the step
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    scale = max(want.max(), 1.0)
    goal, x, y, t = want / scale, np.zeros(len(cols)), np.zeros(len(cols)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - goal) / (top * 1.01))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if np.dot(y - new, new - x) > 0:  # restart when the momentum points uphill
            nt, y = 1.0, new
        else:
            y = new + (t - 1) / nt * (new - x)
        x, t = new, nt
    return x * scale


@dataclass
class Plan:
    """Windows by pattern, and for each length class the runs of places its pieces take."""

    grid: int
    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def places(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By class: number of the first piece of each run, pieces a window takes, first window."""
        runs: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        window = 0
        for parts, times in self.patterns:
            for c in set(parts):
                uses = parts.count(c)
                runs.setdefault(c, []).append((taken.get(c, 0), uses, window))
                taken[c] = taken.get(c, 0) + uses * times
            window += times
        return {c: tuple(np.array(v, np.int64) for v in zip(*r)) for c, r in runs.items()}


def plan(counts: dict[int, int], window: int = WINDOW, depth: int = DEPTH, classes: int = CLASSES) -> Plan:
    """Patterns that place every piece; ``counts`` has the number of pieces by length."""
    grid = max(1, -(-window // classes))
    units = window // grid
    left = np.zeros(-(-window // grid) + 1, np.int64)
    for length, n in counts.items():
        left[-(-length // grid)] += n
    out = Plan(grid)
    if not left.sum():
        return out
    ways = [m for m in mixes(units, depth) if all(left[p] for p in m)]
    if ways:
        exact = non_negative(ways, left.astype(float))
        for i in np.argsort(-exact, kind="stable"):
            parts = ways[i]
            times = min(int(exact[i] + 0.5), *(int(left[p]) // parts.count(p) for p in set(parts)))
            if times > 0:
                out.patterns.append((parts, times))
                for p in parts:
                    left[p] -= times
    # Lengths beyond the whole grid steps of a window stand alone; the rest goes longest first.
    while left.any():
        parts, room, use = [], window, left.copy()
        for p in range(len(left) - 1, 0, -1):
            most = min(int(use[p]), room // (p * grid)) if p * grid <= room else int(not parts and use[p] > 0)
            parts += [p] * most
            room -= most * p * grid
            if room <= 0:
                break
        times = min(int(left[p]) // parts.count(p) for p in set(parts))
        out.patterns.append((tuple(parts), times))
        for p in parts:
            left[p] -= times
    return out


def pack(pieces: DataFrame, window: int = WINDOW, depth: int = DEPTH, classes: int = CLASSES) -> DataFrame:
    """``pieces`` (doc_id, start, length, ids_crc32 and more) with ``sequence_id`` and ``offset``.

    Pieces are at most ``window`` long.  The plan is made on the driver from the
    histogram, whose size the window bounds; tasks get the plan's runs.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, window, depth, classes)
    groups = max(1, -(-sum(counts.values()) // GROUP))
    klass = F.ceil(F.col("length") / F.lit(made.grid)).cast("int")
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int")
    rows = pieces.withColumns({"_class": klass, "_group": spread})
    order = [F.col("doc_id"), F.col("start"), F.col("ids_crc32"), F.col("length")]
    by = Window.partitionBy("_class").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_class", "_group").agg(F.count("*").alias("_n")).select(
        "_class", "_group", F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_class", "_group").orderBy(*order)) - 1
    ranked = rows.withColumn("_inside", inside).join(before, ["_class", "_group"]).withColumn("_rank", F.col("_before") + F.col("_inside"))
    places = made.places()

    @F.pandas_udf("long")
    def sequence(klass: pd.Series, rank: pd.Series) -> pd.Series:
        c, r = klass.to_numpy(), rank.to_numpy()
        out = np.zeros(len(c), np.int64)
        for k in np.unique(c):
            first, uses, start = places[int(k)]
            at = c == k
            run = np.searchsorted(first, r[at], "right") - 1
            out[at] = start[run] + (r[at] - first[run]) // uses[run]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", sequence("_class", "_rank"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("_class", "_group", "_inside", "_before", "_rank")


def pack_documents(docs: DataFrame, window: int = WINDOW, end: int = END, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; the tokens are made once."""
    return pack(durable(token_pieces(docs, window, end, tokenizer, with_ids), "pieces"), window)
