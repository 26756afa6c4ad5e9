"""Secret scan by grammar inference.

Plain patterns find labelled credentials of three kinds (``base`` spans).  From
their values one probabilistic automaton per kind is inferred: values become
symbol strings, the strings a prefix tree with counts, and states of the tree
whose continuations don't differ significantly (Hoeffding bound) are merged,
which turns the tree into an automaton of the format.  Every credential-like
token of the corpus is then scored: log likelihood of its symbols under the best
automaton, less that under a background chain of all tokens, per symbol.  Tokens
that score like labelled credentials are added as ``format`` spans.

The automata are fitted on at most ``SAMPLE`` distinct values of each kind,
chosen by hash; the background counts cover all tokens of all texts, and every
token of every text is scored.

Nulls and edge cases: a null text is empty and has no spans; a null ``doc_id`` is
an id like any other; repeated rows are scanned each; offsets are code points;
without labelled credentials nothing is added to the base spans; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import batches, durable

KINDS = ("assign", "access", "hex")
ADDED = "format"
#: Distinct labelled values of each kind that an automaton is fitted on, at most.
SAMPLE = 1500
#: Significance of the merge test.
ALPHA = 0.05
#: Share of labelled values that the bar of a format lets pass.
PASS = 0.95
#: Nats per symbol by which a format must beat the background at least.
MARGIN = 0.5
SHORTEST = 12

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")

# Symbols: digits, the letters of hexadecimal numbers, other lower-case letters,
# upper-case letters, and each mark by itself.
_MARKS = b"+/_.=-"
_SYMBOL = np.full(256, 255, np.uint8)
_SYMBOL[list(b"0123456789")] = 0
_SYMBOL[list(b"abcdef")] = 1
_SYMBOL[list(b"ghijklmnopqrstuvwxyz")] = 2
_SYMBOL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 3
for _i, _c in enumerate(_MARKS):
    _SYMBOL[_c] = 4 + _i
SYMBOLS = 4 + len(_MARKS)
_TOKEN = _SYMBOL < 255
_HEXES = _SYMBOL < 2


def base_matches(text: bytes, hexes: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of base spans in bytes, by start and kind.

    ``hexes``: the runs of 16 or more hexadecimal digits, if they are known.
    """
    out = []
    low = text.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if b"AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                out.append((m.start(), 1, m.end(), m.start(), m.end()))
    for a, b in [m.span() for m in _HEX.finditer(text)] if hexes is None else hexes:
        out.append((a, 2, b, a, b))
    out.sort()
    return out


def _runs(mask: np.ndarray, edge: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of set bytes that don't cross a row's edge, of ``least`` bytes or more."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= least
    return a[long], b[long]


def _edges(n: int, offs: np.ndarray) -> np.ndarray:
    edge = np.zeros(n, bool)
    edge[offs[:-1][offs[:-1] < n]] = True
    return edge


def _scan(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, bytes, list, np.ndarray, np.ndarray]]:
    """For each row: number, bytes, base matches, and first and last byte of its tokens."""
    edge = _edges(len(raw), offs)
    ha, hb = _runs(_HEXES[raw], edge, 16)
    ta, tb = _runs(_TOKEN[raw], edge, SHORTEST)
    h, t = np.searchsorted(ha, offs), np.searchsorted(ta, offs)
    whole = raw.tobytes()
    for i in range(len(offs) - 1):
        o = int(offs[i])
        text = whole[o : int(offs[i + 1])]
        hexes = [(int(a) - o, int(b) - o) for a, b in zip(ha[h[i] : h[i + 1]], hb[h[i] : h[i + 1]])]
        yield i, text, base_matches(text, hexes), ta[t[i] : t[i + 1]] - o, tb[t[i] : t[i + 1]] - o


def symbols(token: bytes) -> np.ndarray:
    return _SYMBOL[np.frombuffer(token, np.uint8)]


class Automaton:
    """Probabilistic automaton: ``step[state, symbol]`` and log probability ``log[state, symbol]``; the last state is a sink."""

    def __init__(self, step: np.ndarray, log: np.ndarray, stop: np.ndarray):
        self.step, self.log, self.stop = step, log, stop


def infer(values: Iterable[bytes], alpha: float = ALPHA) -> Automaton:
    """Prefix tree of the values' symbols, with compatible states merged."""
    child: list[dict[int, int]] = [{}]
    through, ends, uses = [0], [0], [defaultdict(int)]
    for v in values:
        s = 0
        through[0] += 1
        for x in symbols(v).tolist():
            uses[s][x] += 1
            if x not in child[s]:
                child[s][x] = len(child)
                child.append({})
                through.append(0)
                ends.append(0)
                uses.append(defaultdict(int))
            s = child[s][x]
            through[s] += 1
        ends[s] += 1
    width = (0.5 * np.log(2 / alpha)) ** 0.5

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > width * (n**-0.5 + m**-0.5)

    def compatible(r: int, s: int) -> bool:
        todo = [(r, s)]
        while todo:
            r, s = todo.pop()
            if differ(ends[r], through[r], ends[s], through[s]):
                return False
            for x in uses[r].keys() | uses[s].keys():
                if differ(uses[r].get(x, 0), through[r], uses[s].get(x, 0), through[s]):
                    return False
                if x in child[r] and x in child[s]:
                    todo.append((child[r][x], child[s][x]))
        return True

    def fold(r: int, s: int) -> None:
        todo = [(r, s)]
        while todo:
            r, s = todo.pop()
            through[r] += through[s]
            ends[r] += ends[s]
            for x, n in uses[s].items():
                uses[r][x] += n
            for x, t in child[s].items():
                if x in child[r]:
                    todo.append((child[r][x], t))
                else:
                    child[r][x] = t

    red = [0]
    while True:
        known = set(red)
        blue = [(q, x, t) for q in red for x, t in sorted(child[q].items()) if t not in known]
        if not blue:
            break
        q, x, t = max(blue, key=lambda e: (through[e[2]], -e[2]))
        for r in red:
            if compatible(r, t):
                child[q][x] = r
                fold(r, t)
                break
        else:
            red.append(t)
    number = {s: i for i, s in enumerate(red)}
    sink = len(red)
    step = np.full((sink + 1, SYMBOLS), sink, np.int64)
    log = np.full((sink + 1, SYMBOLS), np.log(1e-4))
    stop = np.full(sink + 1, np.log(1e-4))
    for s, i in number.items():
        total = through[s] + 0.5
        for x in range(SYMBOLS):
            log[i, x] = np.log((uses[s].get(x, 0) + 0.5 / (SYMBOLS + 1)) / total)
            step[i, x] = number.get(child[s].get(x, -1), sink)
        stop[i] = np.log((ends[s] + 0.5 / (SYMBOLS + 1)) / total)
    return Automaton(step, log, stop)


def _walk(data: np.ndarray, a: np.ndarray, b: np.ndarray, step: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability and last state of every token, all tokens one symbol at a time."""
    state, total = np.zeros(len(a), np.int64), np.zeros(len(a))
    order = np.argsort(a - b, kind="stable")  # longest first, so that those still open come first
    a, size = a[order], (b - a)[order]
    st, to = state[order], total[order]
    longest = int(size[0]) if len(size) else 0
    if longest > 4096:  # few tokens of any length: symbol by symbol
        for k in np.flatnonzero(size > 4096):
            s, t = 0, 0.0
            for x in data[a[k] : a[k] + size[k]].tolist():
                t += log[s, x]
                s = step[s, x]
            st[k], to[k] = s, t
    short = size <= 4096
    first = int((~short).sum())
    for i in range(int(size[first]) if first < len(size) else 0):
        n = int(np.searchsorted(-size, -i, "left"))  # tokens with more than i symbols
        x = data[a[first:n] + i]
        to[first:n] += log[st[first:n], x]
        st[first:n] = step[st[first:n], x]
    state[order], total[order] = st, to
    return total, state


class Formats:
    """The automata of all kinds, the background chain, and the bar of each kind."""

    def __init__(self, automata: list[Automaton], pairs: np.ndarray):
        self.automata = automata
        self.chain = np.log((pairs + 1.0) / (pairs + 1.0).sum(1, keepdims=True))
        self.follow = np.tile(np.arange(1, SYMBOLS + 1), (SYMBOLS + 1, 1))
        self.bars = [np.inf] * len(automata)

    def scores(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(kinds x tokens): nats per symbol above the background."""
        ground, last = _walk(data, a, b, self.follow, self.chain[:, :SYMBOLS])
        ground += self.chain[last, SYMBOLS]
        out = np.empty((len(self.automata), len(a)))
        for k, m in enumerate(self.automata):
            own, last = _walk(data, a, b, m.step, m.log)
            out[k] = (own + m.stop[last] - ground) / (b - a + 1)
        return out

    def set_bars(self, values: list[list[bytes]], share: float, margin: float) -> None:
        for k, own in enumerate(values):
            if own:
                sizes = np.array([len(v) for v in own])
                ends = np.cumsum(sizes)
                got = self.scores(symbols(b"".join(own)), ends - sizes, ends)[k]
                self.bars[k] = max(margin, float(np.quantile(got, 1 - share)))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata and background from one pass over all texts.

    Each task sends its distinct labelled values and one table of symbol pairs;
    of the values, ``sample`` of each kind come to the driver.
    """

    def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((SYMBOLS + 1, SYMBOLS + 1), np.int64)
        kinds, values = [], []
        for batch in rows:
            for _, _, raw, offs in batches(batch, 0):
                edge = _edges(len(raw), offs)
                sym = _SYMBOL[raw].astype(np.int64)
                ta, tb = _runs(_TOKEN[raw], edge, SHORTEST)
                inside = np.zeros(len(raw) + 1, np.int8)
                inside[ta] += 1
                inside[tb] -= 1
                at = np.flatnonzero(np.cumsum(inside[:-1]))
                before = np.zeros(len(raw), np.int64)
                before[1:] = sym[:-1] + 1
                before[ta] = 0
                pairs += np.bincount(before[at] * (SYMBOLS + 1) + sym[at], minlength=pairs.size).reshape(pairs.shape)
                pairs[:, SYMBOLS] += np.bincount(sym[tb - 1] + 1, minlength=SYMBOLS + 1)
                whole = raw.tobytes()
                ha, hb = _runs(_HEXES[raw], edge, 16)
                h = np.searchsorted(ha, offs)
                for i in range(len(offs) - 1):
                    o = int(offs[i])
                    text = whole[o : int(offs[i + 1])]
                    hexes = [(int(a) - o, int(b) - o) for a, b in zip(ha[h[i] : h[i + 1]], hb[h[i] : h[i + 1]])]
                    for _, kind, _, a, b in base_matches(text, hexes):
                        kinds.append(kind)
                        values.append(text[a:b].decode())
                if len(values) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.array([1] * len(kinds), pa.int64())], ["kind", "value", "n"])
                    kinds, values = [], []
        cells = np.flatnonzero(pairs)
        kinds += [-1] * len(cells)
        values += [str(c) for c in cells]
        counts = [1] * (len(kinds) - len(cells)) + pairs.ravel()[cells].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], ["kind", "value", "n"])

    text = F.col("text").cast("string").alias("text")
    found = durable(docs.select(text).mapInArrow(gather, "kind int, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    pairs = np.zeros((SYMBOLS + 1, SYMBOLS + 1), np.int64)
    for row in found.filter("kind = -1").collect():  # a row per symbol pair
        pairs.ravel()[int(row["value"])] = row["n"]
    values = []
    for kind in range(len(KINDS)):
        own = found.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample).collect()
        values.append([r["value"].encode() for r in own])
    formats = Formats([infer(v) for v in values], pairs)
    formats.set_bars(values, PASS, MARGIN)
    return formats


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, kinds, starts, ends) of all spans of every document, by start and kind, in code points."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kinds, starts, ends = [], [], []
            for _, _, raw, offs in batches(batch, 1):
                docs_, where, sym = [], [], _SYMBOL[raw]
                for i, text, base, a, b in _scan(raw, offs):
                    docs_.append((text, base))
                    where.append((np.full(len(a), i), a + int(offs[i]), b + int(offs[i])))
                owner, a, b = (np.concatenate(x) for x in zip(*where))
                added: dict[int, list[tuple[int, int]]] = defaultdict(list)
                if len(a):
                    hit = (formats.scores(sym, a, b) >= np.array(formats.bars)[:, None]).any(0)
                    for k in np.flatnonzero(hit):
                        i = int(owner[k])
                        added[i].append((int(a[k] - offs[i]), int(b[k] - offs[i])))
                for i, (text, base) in enumerate(docs_):
                    spans = [(a, k, b) for a, k, b, _, _ in base]
                    spans += [(a, len(KINDS), b) for a, b in added.get(i, ()) if all(b <= x or a >= y for x, _, y, _, _ in base)]
                    spans.sort()
                    kinds.append([k for _, k, _ in spans])
                    points = _points(text, spans)
                    starts.append([points[a] for a, _, _ in spans])
                    ends.append([points[b] for _, _, b in spans])
            lists = [pa.array(kinds, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "kinds", "starts", "ends"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, kinds array<int>, starts array<long>, ends array<long>")


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> dict[int, int]:
    """Code points before each byte offset in use."""
    out, at, n = {}, 0, 0
    for o in sorted({x for a, _, b in spans for x in (a, b)}):
        n += len(text[at:o].decode("utf-8", "replace"))
        out[o], at = n, o
    return out


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Spans of every document: what the patterns find, and what looks like it."""
    return scan(docs, fit(docs, sample))


def spans_text(kinds: list[int], starts: list[int], ends: list[int], base_only: bool = False) -> str:
    names = (*KINDS, ADDED)
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in zip(kinds, starts, ends) if k < len(KINDS) or not base_only)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
