"""Removal of passages that stand in an earlier document, by merging Burrows-Wheeler transforms.

A byte goes if it is covered by a string of ``WIDTH`` bytes that also starts in a document with a
smaller id.  Strings are judged on the input.

One merged transform of a whole corpus would be one task's work, so the corpus is first cut such
that equal strings always meet, and each part is merged on its own:

1. Rows are dealt into runs of about ``RUN`` bytes, stored once as a bucketed table; every later
   step reads its run in place, without a shuffle of texts.
2. In every string of ``WIDTH`` bytes the ``GRAM`` bytes with the smallest hash are its anchor.  Equal
   strings have equal anchors.  A run lists its anchors' hashes; a part of the hash range tells each
   run which of them other documents have, too.  Truncated hashes only let more through.  Anchors
   have small hashes by their making, so these are mixed once more before parts divide them.
3. Around each shared anchor lies a content: the bytes of the strings that have it as their anchor.  A
   run offers the contents' digests with the smallest id of each; the part says which contents another
   document owns (all their strings go), which are alone with their anchor (nothing to compare), and
   which the run shall send.  Anchors that occur ``HOT`` times or more, in however few documents, are offered
   string by string, under the strings' own digests, so that no part gathers all surroundings of a common anchor.
4. A part sorts the suffixes of shards of the contents it was sent, and merges the shards' transforms: the
   interleaving starts without order and is refined by ``STEP`` bytes a round, each round dealing the
   shards' symbols out stably in the present order.  What shares its first bytes is a block; blocks
   of one suffix need no further rounds.  After ``WIDTH`` bytes the blocks are the repeated intervals;
   the smallest id in an interval decides for its other members.
5. A run reads the answers, covers bytes and digests what is left.

Nulls and edge cases: null text is empty; a row without an id loses nothing and takes nothing from
others; rows with one id take nothing from one another, whatever their texts; texts shorter than
``WIDTH`` stay; copies of a longer text lose all bytes but in the smallest id; an empty table gives
no row.  A text is held whole by the task of its run, with about five times its bytes.  Contents of
an anchor are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar import session
from daftar.llm.common import durable

WIDTH, GRAM = 50, 16
#: Bytes of a run, of the text that a part answers for, and of a merge.
RUN, PART, MERGE = 2 << 20, 16 << 20, 1 << 17
#: Bytes of a symbol of the transform, and shards of a merge.
STEP, SHARDS = 8, 4

_CHUNK = 1 << 15
_REACH = WIDTH - GRAM + 1  # places of an anchor in its string; also the most strings of one anchor
_SEGMENT = _REACH + WIDTH - 1
#: Occurrences from which on an anchor's strings are offered one by one: what fewer ones surround is half a megabyte.
HOT = 6000
_ALL = np.uint64((1 << 63) - 1)
#: What a part says of a content: its strings stay, they all go, or its bytes are asked for.
_STAYS, _GOES, _ASKED = range(3)
#: Kinds of rows that a run is told.
_SHARED, _VERDICT, _MASK = range(3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTE = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = _mixed((np.arange(_SEGMENT + 8, dtype=np.uint64) + np.uint64(999)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on, by doubling."""
    h, k = _BYTE[raw], 1
    while k < GRAM:
        h = h[:-k] * _FACTOR[k] + h[k:]
        k *= 2
    return _mixed(h)


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first string, strings) of each anchor: strings that follow one another and have it in common.

    ``offs`` has the rows' first bytes and the end.  Works in pieces, so that
    what it keeps is a fraction of the text.  The hashes are spread evenly, unlike
    the smallest ones by which anchors are found.
    """
    length = np.diff(offs)
    last = np.maximum(offs[:-1], offs[1:] - WIDTH + 1)  # behind the last string of a row
    cuts = np.concatenate([offs[:-1], last])
    cuts.sort()
    hashes, firsts = [], []
    total = max(len(raw) - WIDTH + 1, 0)
    for at in range(0, total, _CHUNK):
        to = min(at + _CHUNK, total)
        h = gram_hashes(raw[at : to + WIDTH - 1])
        low = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        for k in (1, 2, 4, 8, 16, _REACH - 32):
            low = np.minimum(low[:-k], low[k:])
        place = (low & np.uint64(0xFFFF)).astype(np.int64)
        new = np.empty(to - at, bool)
        new[0] = True
        new[1:] = place[1:] != place[:-1]
        own = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, to)]
        new[own - at] = True
        first = np.flatnonzero(new)
        hashes.append(_mixed(h[place[first]]))
        firsts.append(first + at)
    if not firsts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, first = np.concatenate(hashes), np.concatenate(firsts)
    n = np.diff(np.append(first, total))
    row = np.searchsorted(offs, first, "right") - 1
    keep = (first < last[row]) & (length[row] >= WIDTH)
    return h[keep], row[keep], first[keep], np.minimum(n, last[row] - first)[keep]


class _Run:
    """The rows of a run in a fixed order, and their anchors."""

    def __init__(self, table: pa.Table) -> None:
        table = table.select(["doc_id", "text"])
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
        self.ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        text = pa.concat_arrays(table.column("text").chunks) if table.num_rows else pa.array([], pa.binary())
        _, offs, data = text.buffers()
        self.offs = np.frombuffer(offs, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        self.raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.raw = self.raw[self.offs[0] : self.offs[-1]]
        self.offs = self.offs - self.offs[0]
        known = np.asarray(self.ids.is_valid())
        self.doc = self.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        h, row, first, n = anchors(self.raw, self.offs)
        keep = known[row] if len(row) else np.zeros(0, bool)
        self.hash, self.row, self.first, self.n = h[keep], row[keep], first[keep], n[keep]

    def words(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The bytes from each place on as a row, zero behind the length."""
        width = -(-_SEGMENT // 8) * 8
        padded = np.concatenate([self.raw[first.min() : first.max() + width], np.zeros(width, np.uint8)])
        out = np.lib.stride_tricks.sliding_window_view(padded, width)[first - first.min()]
        out[np.arange(width) >= length[:, None]] = 0
        return out

    def digests(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.uint64)
        for at in range(0, len(first), 1 << 13):
            part = slice(at, at + (1 << 13))
            words = np.ascontiguousarray(self.words(first[part], length[part])).view(np.uint64)
            out[part] = _mixed((_mixed(words + _FACTOR[: words.shape[1]]) * _FACTOR[: words.shape[1]]).sum(1, dtype=np.uint64) + length[part].astype(np.uint64))
        return out

    def contents(self, shared: dict[int, tuple[np.ndarray, np.ndarray]], bits: int) -> "_Contents":
        """What the run sends: distinct contents around shared anchors."""
        part, key = split_hash(self.hash, bits)
        code = part.astype(np.uint64) << np.uint64(32) | key
        known = np.concatenate([np.uint64(p) << np.uint64(32) | k for p, (k, _) in sorted(shared.items())]) if shared else np.zeros(0, np.uint64)
        hot = np.concatenate([x for _, (_, x) in sorted(shared.items())]) if shared else np.zeros(0, bool)
        place = np.searchsorted(known, code)
        hit = np.zeros(len(code), bool)
        inside = place < len(known)
        hit[inside] = known[place[inside]] == code[inside]
        h, row, first, n, hot = self.hash[hit], self.row[hit], self.first[hit], self.n[hit], hot[place[hit]] if len(known) else np.zeros(0, bool)
        each = np.repeat(np.flatnonzero(hot), n[hot])
        step = np.arange(len(each)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
        row, first, n = np.concatenate([row[~hot], row[each]]), np.concatenate([first[~hot], first[each] + step]), np.concatenate([n[~hot], np.ones(len(each), np.int64)])
        digest = self.digests(first, n + WIDTH - 1)
        key = np.concatenate([h[~hot], digest[len(h) - hot.sum() :]])
        order = np.lexsort((self.doc[row], digest, key))
        key, digest, row, first, n = key[order], digest[order], row[order], first[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        return _Contents(key, digest, row, first, n, np.flatnonzero(new), np.cumsum(new) - 1)


class _Contents:
    """Occurrences of contents, sorted; ``at`` has the first one of each (the smallest id's), ``of`` each one's content."""

    def __init__(self, key, digest, row, first, n, at, of) -> None:
        self.key, self.digest, self.row, self.first, self.n, self.at, self.of = key, digest, row, first, n, at, of

    def parts(self, bits: int) -> Iterator[tuple[int, int, int]]:
        """(part, first content, content behind the last)."""
        part = split_hash(self.key[self.at], bits)[0].astype(np.int64)
        for p in np.unique(part).tolist():
            yield p, int(np.searchsorted(part, p)), int(np.searchsorted(part, p, "right"))


def split_hash(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of a hash (its leading bits) and the next 32 bits."""
    part = h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)
    return part, h >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)


def shard_transform(words: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in suffix order, symbol before each, rank of the suffix that starts with it or -1).

    ``words`` has the STEP bytes from each place of the text on, ``place`` the
    shard's places in order, ``left`` the bytes that a place has behind it in its
    content.  Suffixes are ordered as far as a merge looks: by their first bytes, then
    those that are still level by the order of what follows, twice as far each time.
    """
    n = len(place)
    begin = np.zeros(n, np.uint64)
    whole = left >= STEP
    begin[whole] = words[place[whole]]
    order = np.argsort(begin, kind="stable")
    new = np.ones(n + 1, bool)
    new[1:-1] = begin[order[1:]] != begin[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:-1], np.arange(n), 0))
    depth = STEP
    while depth < WIDTH:
        level = np.flatnonzero(~(new[:-1] & new[1:]))
        own = order[level]
        follows = np.where(left[own] >= depth, rank[np.minimum(own + depth, n - 1)] + 1, 0)  # a content's places follow one another
        by = rank[own] * (n + 1) + follows
        turn = np.argsort(by, kind="stable")
        order[level], by = own[turn], by[turn]
        new[level[1:]] = by[1:] != by[:-1]
        rank[order[level]] = np.maximum.accumulate(np.where(new[level], level, 0))
        depth *= 2
    rank[order] = np.arange(n)
    spot = order - STEP
    whole = spot >= 0
    whole[whole] = left[spot[whole]] == left[order[whole]] + STEP
    symbol = np.zeros(n, np.uint64)
    symbol[whole] = words[place[spot[whole]]]
    before = np.full(n, -1)
    before[whole] = rank[spot[whole]]
    return place[order], symbol, before


def merged_intervals(raw: np.ndarray, offs: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(place, interval) of the strings of WIDTH bytes that occur twice or more in the contents.

    The shards' transforms are merged by refining their interleaving, STEP bytes
    a round: elements take turns in the present order, each hands its suffix's
    predecessor on, and a stable distribution by the predecessors' symbols is the
    order by STEP more bytes.  Two neighbours stay in one block while their
    symbols and the blocks they come from agree; so blocks are runs whose common
    prefix is long enough, and no suffixes are sorted anew.
    """
    padded = np.concatenate([raw, np.zeros(STEP, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, STEP)[: len(raw) + 1]
    words = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)
    # One place more per content: its end, where the interleaving starts from.
    size = np.diff(offs)
    content = np.repeat(np.arange(len(size)), size + 1)
    inside = np.arange(len(content)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    place, left = offs[:-1][content] + inside, size[content] - inside
    shard = content * shards // max(len(size), 1)
    places, symbols, befores, start = [], [], [], 0
    for s in range(shards):
        own = slice(*np.searchsorted(shard, [s, s + 1]))
        p, symbol, before = shard_transform(words, place[own], left[own])
        places.append(p)
        symbols.append(symbol)
        befores.append(np.where(before < 0, -1, before + start))
        start += len(p)
    at, symbol, before = np.concatenate(places), np.concatenate(symbols), np.concatenate(befores)
    turn = np.arange(len(at))  # no order yet: shard after shard, one block
    block = np.zeros(len(at), np.int64)
    depth = 0
    while depth + STEP <= WIDTH and len(turn):
        has = before[turn] >= 0
        turn, block = turn[has], block[has]
        by = symbol[turn]
        order = np.argsort(by, kind="stable")
        by, block, turn = by[order], block[order], before[turn[order]]
        turn, block = _alike(turn, (by, block))
        depth += STEP
    rest = WIDTH - depth
    spot = at[turn]
    end = np.append(offs[1:], len(raw))[np.searchsorted(offs, spot, "right") - 1] if len(spot) else spot
    long = spot + WIDTH <= end
    spot, block = spot[long], block[long]
    if rest and len(spot):
        by = words[spot + depth] >> np.uint64(8 * (STEP - rest))
        order = np.lexsort((by, block))
        spot, block = _alike(spot[order], (by[order], block[order]))
    return spot, block


def _alike(turn: np.ndarray, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Elements that agree in all keys with a neighbour, and the number of their block."""
    new = np.ones(len(turn) + 1, bool)
    differs = np.zeros(max(len(turn) - 1, 0), bool)
    for k in keys:
        differs |= k[1:] != k[:-1]
    new[1:-1] = differs
    several = ~(new[:-1] & new[1:])
    return turn[several], (np.cumsum(new[:-1]) - 1)[several]


def repeated_in(raw: np.ndarray, offs: np.ndarray, owner: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """For each content, the bits of its strings that a content with a smaller owner has, too."""
    mask = np.zeros(len(owner), np.uint64)
    spot, block = merged_intervals(raw, offs, shards)
    if len(spot):
        content = np.searchsorted(offs, spot, "right") - 1
        least = np.full(block[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, block, owner[content])
        hit = least[block] < owner[content]
        np.bitwise_or.at(mask, content[hit], np.uint64(1) << (spot - offs[content])[hit].astype(np.uint64))
    return mask


def listed_count(times: np.ndarray, several: np.ndarray) -> np.ndarray:
    """A byte: whether several rows have an anchor, and eight times the binary logarithm of its occurrences, rounded up."""
    return (np.minimum(np.ceil(8 * np.log2(times)), 127).astype(np.uint8) | np.where(several, 128, 0).astype(np.uint8)).astype(np.uint8)


def _list_anchors(bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        own = _Run(table)
        order = np.lexsort((own.row, own.hash))
        h, row = own.hash[order], own.row[order]
        spots = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        times = np.diff(np.append(spots, len(h)))
        count = listed_count(times, row[spots + times - 1] > row[spots])
        h = h[spots]
        part, key = split_hash(h, bits)
        parts, spots = np.unique(part.astype(np.int64), return_index=True)
        edges = np.append(spots, len(h)).tolist()
        data = [key[a:b].astype("<u4").tobytes() + count[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        number = table.column("run")[0].as_py()
        return pa.table({"part": pa.array(parts, pa.int64()), "run": pa.array([number] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _find_shared(hot_from: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        runs, part = table.column("run").to_pylist(), table.column("part")
        data = table.column("data").to_pylist()
        sizes = [len(x) // 5 for x in data]
        key = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(data, sizes)])
        count = np.concatenate([np.frombuffer(x, np.uint8, offset=4 * n) for x, n in zip(data, sizes)])
        _, of = np.unique(key, return_inverse=True)
        shared = ((np.bincount(of) > 1) | (np.bincount(of, count >> 7) > 0))[of]
        hot = (np.bincount(of, np.exp2((count & 127) / 8)) >= hot_from)[of]
        out, at = [], 0
        for n in sizes:
            mine = shared[at : at + n]
            out.append(key[at : at + n][mine].tobytes() + hot[at : at + n][mine].astype(np.uint8).tobytes())
            at += n
        return pa.table({"run": pa.array(runs, pa.int64()), "part": part, "data": pa.array(out, pa.binary())}).filter(pa.array([bool(x) for x in out]))

    return run


def _shared_of(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each part, keys in order and whether they are hot."""
    found: dict[int, list] = {}
    for part, data in zip(table.column("part").to_pylist(), table.column("data").to_pylist()):
        n = len(data) // 5
        found.setdefault(part, []).append((np.frombuffer(data, "<u4", n).astype(np.uint64), np.frombuffer(data, np.uint8, offset=4 * n) == 1))
    out = {}
    for part, pieces in found.items():
        key, spot = np.unique(np.concatenate([k for k, _ in pieces]), return_index=True)
        out[part] = key, np.concatenate([x for _, x in pieces])[spot]
    return out


def _of_kind(told: pa.Table, kind: int) -> pa.Table:
    return told.filter(pc.equal(told.column("kind"), kind))


def _in_order(told: pa.Table, kind: int, contents: _Contents, bits: int, of: type) -> np.ndarray:
    """The parts' replies of a kind, one after the other as the contents are; a part that was not asked has none."""
    own = _of_kind(told, kind)
    by_part = dict(zip(own.column("part").to_pylist(), own.column("data").to_pylist()))
    pieces = [np.frombuffer(by_part[p], of) for p, _, _ in contents.parts(bits) if p in by_part]
    return np.concatenate(pieces) if pieces else np.zeros(0, of)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, kinds))})


def _offer(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The digests of a run's contents, for each part."""

    def run(rows: pa.Table, shared: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and shared.num_rows:
            own = _Run(rows)
            found = own.contents(_shared_of(shared), bits)
            number = rows.column("run")[0].as_py()
            key = split_hash(found.key[found.at], bits)[1].astype("<u4")
            digest, doc = found.digest[found.at], own.doc[found.row[found.at]]
            for part, a, b in found.parts(bits):
                out.append((part, number, key[a:b].tobytes(), digest[a:b].tobytes(), doc[a:b].tobytes()))
        return _table(out, ["part", "run", "keys", "digests", "ids"])

    return run


def _decide(table: pa.Table) -> pa.Table:
    """For each run, a verdict on each content it offered, in its order."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    key = np.concatenate([np.frombuffer(x, "<u4") for x in cols["keys"]])
    digest = np.concatenate([np.frombuffer(x, np.uint64) for x in cols["digests"]])
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in cols["ids"]])
    order = np.lexsort((doc, digest, key))
    k, d = key[order], digest[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], d[1:] != d[:-1]])
    of, group = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    several = np.bincount(group[new])[group] > 1
    verdict = np.empty(len(order), np.uint8)
    verdict[order] = np.where(doc[order] > doc[order][new][of], _GOES, np.where(several, _ASKED, _STAYS))
    edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in cols["keys"]])]).tolist()
    return _table([(run, part, verdict[a:b].tobytes()) for run, part, a, b in zip(cols["run"], cols["part"], edges[:-1], edges[1:])], ["run", "part", "data"])


def _send(bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The bytes of the contents that the parts asked for."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and told.num_rows:
            own = _Run(rows)
            found = own.contents(_shared_of(_of_kind(told, _SHARED)), bits)
            asked = _in_order(told, _VERDICT, found, bits, np.uint8) == _ASKED
            number = rows.column("run")[0].as_py()
            key = split_hash(found.key[found.at], bits)[1].astype("<u4")
            for part, a, b in found.parts(bits):
                pick = a + np.flatnonzero(asked[a:b])
                if len(pick):
                    at = found.at[pick]
                    size = found.n[at] + WIDTH - 1
                    text = b"".join(own.raw[f : f + n].tobytes() for f, n in zip(found.first[at].tolist(), size.tolist()))
                    out.append((part, number, key[pick].tobytes(), own.doc[found.row[at]].tobytes(), size.astype(np.uint8).tobytes(), text))
        return _table(out, ["part", "run", "keys", "ids", "sizes", "texts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each run, a bit mask per content it sent, in its order."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    key = np.concatenate([np.frombuffer(x, "<u4") for x in cols["keys"]])
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in cols["ids"]])
    size = np.concatenate([np.frombuffer(x, np.uint8) for x in cols["sizes"]]).astype(np.int64)
    raw = np.frombuffer(b"".join(cols["texts"]), np.uint8)
    offs = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(key, kind="stable")
    # whole groups of a key, about MERGE bytes at a time
    last = np.flatnonzero(np.concatenate([key[order][1:] != key[order][:-1], [True]])) + 1
    upto = np.cumsum(size[order])[last - 1] // MERGE
    cuts = [0, *last[np.flatnonzero(np.concatenate([upto[1:] != upto[:-1], [True]]))].tolist()]
    mask = np.zeros(len(key), np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        pieces = [raw[x:y] for x, y in zip(offs[own].tolist(), offs[own + 1].tolist())]
        mask[own] = repeated_in(np.concatenate(pieces), np.concatenate([[0], np.cumsum(size[own])]), doc[own])
    edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in cols["keys"]])]).tolist()
    return _table([(run, part, mask[a:b].tobytes()) for run, part, a, b in zip(cols["run"], cols["part"], edges[:-1], edges[1:])], ["run", "part", "data"])


def _remove(bits: int, texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        own = _Run(rows)
        shared = _shared_of(_of_kind(told, _SHARED))
        change = np.zeros(len(own.raw) + 1, np.int32)
        if shared:
            found = own.contents(shared, bits)
            verdict = _in_order(told, _VERDICT, found, bits, np.uint8)
            mask = np.where(verdict == _GOES, _ALL, np.uint64(0))
            mask[verdict == _ASKED] = _in_order(told, _MASK, found, bits, np.uint64)
            doc = own.doc[found.row]
            each = np.where(doc > doc[found.at][found.of], _ALL, mask[found.of])
            whole = each == _ALL
            np.add.at(change, found.first[whole], 1)
            np.add.at(change, (found.first + found.n + WIDTH - 1)[whole], -1)
            some = ~whole & (each > 0)
            first, each = found.first[some], each[some]
            for k in range(_REACH):
                hit = first[each >> np.uint64(k) & np.uint64(1) == 1]
                np.add.at(change, hit + k, 1)
                np.add.at(change, hit + k + WIDTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        starts = own.offs[:-1][own.offs[:-1] < len(gone)]
        begin[starts] = gone[starts]
        upto = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(begin)])
        a, b = own.offs[:-1], own.offs[1:]
        kept = [own.raw[x:y][~gone[x:y]].tobytes() if upto[y] > upto[x] else own.raw[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
        out = {
            "doc_id": own.ids.cast(pa.int64()), "n_bytes": pa.array(b - a), "n_removed": pa.array(upto[b] - upto[a]), "n_spans": pa.array(spans[b] - spans[a]),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    return run


def _runs(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (run, doc_id, text) as a table with one file per run or so, and the bits of a part."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(1, -(-total // RUN))
    rows = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "text"), F.lit(runs)))
    name, buckets = f"llm_runs_{uuid.uuid4().hex}", min(runs, 20_000)
    table = rows.repartition(buckets, "run").write.bucketBy(buckets, "run").option("compression", "zstd").option("path", session.scratch_path(spark, "llm-runs"))
    table.format("parquet").saveAsTable(name)
    return spark.table(name), max(0, (-(-total // PART) - 1).bit_length())


def remove_repeats(docs: DataFrame, texts: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, with ``texts`` also the kept bytes) of every row."""
    rows, bits = _runs(docs)
    # Parts are dealt out by number: adaptive execution would put many into one task by their bytes, but their work is in the merging.
    listed = rows.groupBy("run").applyInArrow(_list_anchors(bits), "part long, run long, data binary").repartition(1 << bits, "part")
    shared = durable(listed.groupBy("part").applyInArrow(_find_shared(hot), "run long, part long, data binary"), "shared")
    reply = "run long, part long, data binary"

    def ask(told: DataFrame, what: Callable[[pa.Table, pa.Table], pa.Table], kind: str) -> DataFrame:
        return rows.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(what, kind).repartition(1 << bits, "part").groupBy("part")

    offers = ask(shared, _offer(bits), "part long, run long, keys binary, digests binary, ids binary")
    verdicts = durable(offers.applyInArrow(_decide, reply), "verdicts")
    told = shared.withColumn("kind", F.lit(_SHARED)).unionByName(verdicts.withColumn("kind", F.lit(_VERDICT)))
    sent = ask(told, _send(bits), "part long, run long, keys binary, ids binary, sizes binary, texts binary")
    masks = durable(sent.applyInArrow(_answer, reply), "masks")
    told = told.unionByName(masks.withColumn("kind", F.lit(_MASK)))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return rows.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(_remove(bits, texts), kind)
