"""Near duplicates by SimHash: tiled exact comparison of 64-bit fingerprints.

A fingerprint has a bit set if more than half of the document's word shingles
have it set in their hash.  Two documents are linked if their fingerprints
differ in at most ``radius`` bits; what links reach, directly or through others,
is one group.

Comparing is exact and never samples.  Equal fingerprints are one row from the
start.  Fingerprints within ``radius`` bits agree in at least one of
``radius + 1`` bit ranges, so rows meet per (range, value).  Inside such a bucket
the rows are laid in tiles by their number of set bits; tiles whose counts
differ by more than the radius can't hold a link and are skipped, the others are
compared by exclusive-or and bit count in numpy, block by block.  A bucket of
any size becomes many tile pairs, each a small unit of work.  A pair of tiles
returns a spanning forest of its links, not the links, which keeps what is
shuffled in proportion to the rows.

Nulls and edge cases: a null text has no words; texts without words have
fingerprint zero, which links like any other; texts with fewer words than a
shingle are one shingle; repeated rows fall together; a null ``doc_id`` is the
largest id of its group (and its group's id only if all ids are null); an empty
table gives an empty result.  Where one row of a group is kept, rows are told apart
by hashes of all their columns, not by ids, which may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar import session
from daftar.llm.common import durable, fresh

SHINGLE = 5
RADIUS = 4
TILE = 2048
SEED = 42
#: Links that one task makes stars of at a time (16 MB).
LINKS = 1 << 20
_CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text, as an unsigned number."""
    import xxhash

    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    del words
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, n)
    total, counts, digest = n - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):  # bounded memory for texts of any length
        to = min(at + _CHUNK, total)
        pieces = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pieces], np.dtype("<u8"))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view(np.dtype("<u8"))[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and the long columns ``carried``) with the fingerprint's bits in a signed long."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = np.fromiter((fingerprint(t, shingle) for t in map(pa.StringScalar.as_py, batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carried])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows joined to the smallest row they reach through the given links."""
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links_within(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows of one tile, or of two, that differ in at most ``radius`` bits.

    Rows are sorted by bit count; a block of rows is compared with no rows whose
    counts lie further away than the radius.
    """
    rows = np.unique(a if b is None else np.concatenate([a, b]))
    pop = np.bitwise_count(rows).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    rows, pop = rows[order], pop[order]
    label = np.arange(len(rows))
    for at in range(0, len(rows), block):
        to = min(at + block, len(rows))
        far = int(np.searchsorted(pop, pop[to - 1] + radius, "right"))
        near = np.bitwise_count(rows[at:to, None] ^ rows[None, at:far]) <= radius
        i, j = np.nonzero(near)
        ahead = j > i
        if ahead.any():
            i, j = label[i[ahead] + at], label[j[ahead] + at]
            pairs = np.unique(np.stack([i, j], 1), axis=0)
            label = _forest(rows, pairs[:, 0], pairs[:, 1])[label]
    child = np.flatnonzero(label != np.arange(len(rows)))
    return rows[child], rows[label[child]]


def _groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of a sorted stream, however batches cut it."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), len(k)]
        for a, b in zip(edges[:-1], edges[1:]):
            part = frame.iloc[a:b]
            if rest and rest[-1][key].iloc[0] != part[key].iloc[0]:
                yield rest[0] if len(rest) == 1 else pd.concat(rest)
                rest = []
            rest.append(part)
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest)


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints that differ in at most ``radius`` bits.

    ``fps`` has one row per distinct fingerprint in column ``fp``.
    """
    ranges = radius + 1
    edges = [round(64 * i / ranges) for i in range(ranges + 1)]
    value = F.array(*[
        F.struct(F.lit(i).alias("r"), F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)).alias("v"))
        for i in range(ranges)
    ])
    rows = durable(
        fps.select("fp", F.bit_count("fp").alias("pop"), F.explode(value).alias("at")).select("fp", "pop", (F.col("at.v") * ranges + F.col("at.r")).alias("bucket")),
        "ranges",
    )
    # Tiles: a bucket that fits in one is one tile; a larger one gets tiles per bit count, cut further by hash.
    sizes = rows.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("bucket"))
    sizes = sizes.withColumn("all", whole).filter(F.col("all") > 1)
    large = durable(
        sizes.filter(F.col("all") > tile).select("bucket", "pop", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("cuts")), "tiles"
    )
    small = rows.join(large.select("bucket").distinct(), "bucket", "left_anti").select(F.col("bucket").alias("pair"), "fp")

    def compare_small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, "pair"):
            if len(group) > 1:
                a, b = links_within(group["fp"].to_numpy().view(np.uint64), None, radius)
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    found = small.repartition("pair").sortWithinPartitions("pair").mapInPandas(compare_small, "a long, b long")
    if large.isEmpty():
        return found
    cut = F.pmod(F.xxhash64("fp"), F.col("cuts").cast("long")).cast("int").alias("cut")
    tiled = rows.join(large, ["bucket", "pop"]).select("bucket", "pop", cut, "fp")
    tiles = large.select("bucket", "pop", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    other = tiles.select("bucket", F.col("pop").alias("pop2"), F.col("cut").alias("cut2"))
    pairs = (
        tiles.join(other, "bucket")
        .filter((F.col("pop2") <= F.col("pop") + radius) & (F.struct("pop", "cut") <= F.struct("pop2", "cut2")))
        .withColumn("pair", F.xxhash64("bucket", "pop", "cut", "pop2", "cut2"))
    )
    sides = pairs.select("bucket", "pop", "cut", "pair").unionByName(
        pairs.select("bucket", F.col("pop2").alias("pop"), F.col("cut2").alias("cut"), "pair")
    ).distinct()
    work = sides.join(tiled, ["bucket", "pop", "cut"]).select("pair", "fp")

    def compare_tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames, "pair"):
            a, b = links_within(group["fp"].to_numpy().view(np.uint64), None, radius)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return found.unionByName(work.repartition("pair").sortWithinPartitions("pair").mapInPandas(compare_tiles, "a long, b long"))


def _contracted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a partition as stars: every node but the smallest of what they connect, with that one."""
    left, right, n = [], [], 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        ends = np.concatenate([*left, *right])
        nodes, place = np.unique(ends, return_inverse=True)
        label = _forest(nodes, place[: len(ends) // 2], place[len(ends) // 2 :])
        child = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[child], nodes[label[child]]

    for batch in frames:
        left.append(batch.column(0).to_numpy())
        right.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n > LINKS:
            u, v = stars()
            left, right, n = [u], [v], 0
    if left:
        yield pa.RecordBatch.from_arrays([*map(pa.array, stars())], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = LINKS) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node with a link.

    Each partition's links become stars first, without a shuffle; up to ``most`` links are
    one partition, and done with that.  More of them alternate two steps until nothing
    changes: every node hands the smallest of its neighbourhood to its larger neighbours,
    then to its smaller ones.  Both keep what is connected connected and flatten it to
    stars, in a number of rounds that grows with the logarithm of the longest chain.
    Each round's links are written to the shared folder; their number and the
    exclusive-or of their hashes, observed meanwhile, say whether a round changed any.
    """
    told: dict = {}

    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = {"n": F.count("*"), "hash": F.bit_xor(F.xxhash64("u", "v"))}
        return session.durable(df, "llm-links", seen, told), told["llm-links"]

    now, state = written(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    final = lambda df: df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if not state["n"]:
        return final(now)
    if state["n"] <= most:
        return final(written(now.coalesce(1).mapInArrow(_contracted, "u long, v long"))[0])
    now, state = now.mapInArrow(_contracted, "u long, v long").distinct(), None
    while True:
        # large star: larger neighbours of u go to the smallest of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        moved = wide.join(low, "u")
        narrow = (
            moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        before = state
        now, state = written(narrow)
        if state == before:
            return final(now)


def rooted(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, root, least) of every distinct fingerprint of ``rows``: the group's smallest fingerprint and the fingerprint's smallest doc_id."""
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp"), radius, tile))
    return durable(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every document; the component's id is its smallest doc_id."""
    rows = durable(fingerprints(docs, shingle), "fingerprints")
    roots = rooted(rows, radius, tile)
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def marked(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two hashes of the whole row, in which nulls count, and the names of the two columns."""
    parts = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    mark, second = fresh(docs, "_mark"), fresh(docs, "_second")
    return docs.withColumns({mark: F.xxhash64(*parts), second: F.hash(*parts).cast("long")}), mark, second


def bitmap(df: DataFrame, key: str, bits: int = 22) -> np.ndarray:
    """Bits of the cells (leading bits) in which ``df`` has a key; a cell without one can't hold it."""
    cells = df.select(F.shiftrightunsigned(key, 64 - bits).cast("int").alias("c")).distinct().toPandas()["c"].to_numpy()
    out = np.zeros(1 << bits, bool)
    out[cells] = True
    return np.packbits(out)


def in_bitmap(keys: np.ndarray, packed: np.ndarray) -> np.ndarray:
    bits = int(len(packed) * 8).bit_length() - 1
    cell = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def one_per_group(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root``: the smallest doc_id's, null last.

    ``rows`` has (mark, second, doc_id, root) of every row, with the hashes of
    ``marked``.  Rows are told apart by these, not by their ids; of rows that
    agree in all columns one stays, and goes through the shuffle once per task.
    Rows that a bitmap shows to be alone in their group are not shuffled.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "second")).alias("first")
    wide, mark, second = marked(docs)
    groups = durable(rows.groupBy("root").agg(first, F.count("*").alias("n")).select("root", "n", F.col("first.mark").alias(mark), F.col("first.second").alias(second)), "chosen")
    several = groups.filter("n > 1")
    packed = bitmap(rows.join(several.select("root"), "root", "left_semi"), "mark")
    spot = wide.columns.index(mark)

    def part(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(batch.column(spot).to_numpy(), packed) == hit))

        return wide.mapInArrow(run, wide.schema)

    n = fresh(wide, "_n")
    rank = F.row_number().over(Window.partitionBy(mark, second).orderBy(mark))
    judged = part(True).withColumn(n, rank).filter(F.col(n) == 1).join(groups.select(mark, second), [mark, second], "left_semi")
    return part(False).select(*docs.columns).unionByName(judged.select(*docs.columns))


def keep_representatives(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near duplicates, with all columns: the smallest doc_id's, whatever ids the group has."""
    wide, mark, second = marked(docs)
    named = wide.select("doc_id", "text", F.col(mark).alias("mark"), F.col(second).alias("second"))
    rows = durable(fingerprints(named, shingle, ("mark", "second")), "fingerprints")
    roots = rooted(rows, radius).select("fp", "root")
    return one_per_group(docs, rows.join(roots, "fp"))
