"""Exact top-k search as a Voronoi kNN join.

The k highest inner products are the k nearest vectors once every data vector
gets one more component that lifts it to a common norm M, and every query a zero:
then distance^2 = |q|^2 + M^2 - 2 q.x.  In that space:

1. pivots are drawn from the data, and queries and data go to their nearest pivot;
2. each cell is summarised: how far its queries and its data lie from the pivot,
   and the distances of the k + 1 nearest data, an id counting once in all cells;
3. from the summaries alone, each query cell gets a bound on the distance of its
   queries' k-th neighbour, and a cell needs a data vector only if the triangle
   inequality can't rule it out;
4. neighbouring query cells make a bundle; a data vector is sent once to each bundle
   with a cell that needs it.  What is sent is cut into blocks; a bundle's queries meet
   a block piece by piece, cell by cell, keeping the best k so far, and the best of
   every query's blocks are merged.

Vectors travel as bytes of the smallest integers that hold them.  Where nothing can be
ruled out, there are as many copies of the data as bundles, not cells, and every task
holds a block, a bundle and the scores of a piece, whatever the tables' sizes.

Nothing is approximate: pivots, their number and block sizes change the work, not
the result.  Scores are sums of whole numbers, exact up to 2^53 (in single precision
where the norms keep them below 2^24).

Nulls and edge cases: vectors that are null or hold a null or non-finite component
take no part, nor do rows with a null id; an empty vector scores 0 with all; of
vectors of unlike length the shorter one is filled with zeros; rows repeated under
one id are candidates each, but never of a query with their id; queries with fewer
than k candidates get all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.common import durable, give_back

K = 20
SCALE = 64
#: Pivots at most: a cell for every PER_CELL queries, within this bound.
PIVOTS, PER_CELL = 256, 512
#: Data vectors in a block at most, and at least if that gives every task one; queries in a bundle.
BLOCK, LEAST, QUERIES = 1 << 16, 1024, 8192
#: Data vectors and queries whose scores are held at a time.
PIECE, ROWS = 4096, 512


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as whole numbers in doubles, without vectors that take no part."""
    v = F.col("embedding").cast("array<double>")
    usable = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows, filled with zeros."""
    length = col.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), dim))
    row = np.repeat(np.arange(len(col)), length)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def smallest_kind(most: float) -> str:
    """The smallest type that holds whole numbers up to ``most``, of either sign."""
    return next((k for k in ("<i1", "<i2", "<i4") if most <= np.iinfo(k).max), "<f8")


def _packed(m: np.ndarray, kind: str) -> pa.Array:
    """Rows as bytes."""
    raw = np.ascontiguousarray(m.astype(kind))
    offs = np.arange(len(m) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offs), pa.py_buffer(raw)])


def _unpacked(col: pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, dim)


def _nearest(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, distance to its pivot, and distances to all pivots, of lifted vectors."""
    full = np.concatenate([x, lift[:, None]], 1)
    square = (full * full).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * full @ pivots.T
    far = np.sqrt(np.maximum(square, 0))
    cell = far.argmin(1)
    return cell, far[np.arange(len(x)), cell], far


def bundles(sizes: dict[int, int], between: np.ndarray, most: int = QUERIES) -> dict[int, tuple[int, int]]:
    """For each cell, its first bundle and how many share its queries: neighbours together up to ``most`` queries, larger cells divided."""
    left, at, out, number, filled = set(sizes), min(sizes), {}, 0, 0
    while left:
        left.discard(at)
        shares = -(-sizes[at] // most)
        if filled and filled + sizes[at] > most:
            number, filled = number + 1, 0
        out[at] = number, shares
        number, filled = (number + shares, 0) if shares > 1 else (number, filled + sizes[at])
        at = min(left, key=lambda c: (between[at, c], c), default=at)
    return out


class _Best:
    """The k best (score, id) so far of each query; vectors come by ascending id, so of equal scores the first ones stay."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the queries from ``first`` on (rows) and the vectors ``ids``; minus infinity: no candidate."""
        k, own = self.k, slice(first, first + len(scores))
        bar = self.score[own, -1].astype(scores.dtype)
        hit = scores > bar[:, None]
        empty = np.flatnonzero(np.isneginf(bar))
        if len(empty) and scores.shape[1] > k:
            hit[empty] &= scores[empty] >= np.partition(scores[empty], -k, axis=1)[:, -k, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        some = np.unique(i)
        rows = np.concatenate([np.repeat(some, k), i])
        score = np.concatenate([self.score[own][some].ravel(), scores[i, j]])
        found = np.concatenate([self.id[own][some].ravel(), ids[j]])
        order = np.lexsort((found, -score, rows))
        rows = rows[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order, rank = order[rank < k], rank[rank < k]
        rows = np.repeat(some, k) + first
        self.score[rows, rank], self.id[rows, rank] = score[order], found[order]


def knn_join(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, pivots: int | None = None, block: int = BLOCK, bundle: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query among all other rows' vectors."""
    data = durable(quantised(vectors, scale), "vectors")
    asked = durable(quantised(queries, scale).groupBy("vec_id", "v").agg(F.count("*").alias("_")).drop("_"), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    told = [F.max(square), F.max(F.size("v")), F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))]
    top, dim, n, most = data.agg(*told).first()
    top_asked, dim_asked, n_asked, most_asked = asked.agg(*told).first()
    if not n or not n_asked:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    dim = max(dim, dim_asked, 1)
    kind = smallest_kind(max(most or 0, most_asked or 0))
    exact = np.float32 if top * top_asked < 2.0**48 else np.float64
    count = min(pivots or PIVOTS, max(1, -(-n_asked // PER_CELL) if pivots is None else pivots))
    chosen = data.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(count).select("v").collect()
    points = _matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.float64())), dim)
    points = np.concatenate([points, np.sqrt(np.maximum(top - (points * points).sum(1), 0))[:, None]], 1)

    def lifted(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _nearest(m, np.sqrt(np.maximum(top - (m * m).sum(1), 0)), points)

    def place_queries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            m = _matrix(b.column(1), dim)
            cell, far, _ = _nearest(m, np.zeros(len(m)), points)
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(m, kind), pa.array(cell.astype(np.int32)), pa.array(far)], ["query_id", "v", "cell", "far"])

    def place_data(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            cell, far, _ = lifted(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(far)], ["vec_id", "cell", "far"])

    located = durable(asked.select("vec_id", "v").mapInArrow(place_queries, "query_id long, v binary, cell int, far double"), "located")
    # Summaries: a row per query cell, and k + 1 rows per data cell.
    reach = {r["cell"]: (r["far"], r["n"]) for r in located.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    near = data.select("vec_id", "v").mapInArrow(place_data, "vec_id long, cell int, far double")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("far", "vec_id"))
    once = near.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("at")).select("vec_id", "at.cell", "at.far")
    nearest = once.withColumn("_n", rank).filter(F.col("_n") <= k + 1).select("cell", "far").toPandas()
    between = np.sqrt(np.maximum((points * points).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * points @ points.T, 0))
    cells = np.array(sorted(reach))
    radius = np.array([reach[c][0] for c in cells])
    # A query of cell c is at most radius + |c j| + far away from a vector of cell j; k + 1 distinct ids, for the query's own may be among them.
    upper = radius[:, None] + between[cells][:, nearest["cell"].to_numpy()] + nearest["far"].to_numpy()[None]
    upper.sort(axis=1)
    bound = upper[:, k] if upper.shape[1] > k else np.full(len(cells), np.inf)
    slack = 1e-6 * (1 + float(np.sqrt(top)))

    def needed(m: np.ndarray) -> np.ndarray:
        """For each vector and query cell, whether the cell's queries may have the vector among their k nearest."""
        cell, own_far, far = lifted(m)
        # |q x| >= |x c| - |q c|; and q lies on c's side of the plane between c and x's own pivot
        apart = between[np.ix_(cell, cells)]
        plane = (far[:, cells] ** 2 - own_far[:, None] ** 2) / np.where(apart > 0, 2 * apart, np.inf)
        return np.maximum(far[:, cells] - radius[None], plane) <= bound[None] + slack

    dealt = bundles({int(c): reach[c][1] for c in cells}, between, bundle)
    groups = max(first + shares for first, shares in dealt.values())
    of_group = [np.array([i for i, c in enumerate(cells) if dealt[int(c)][0] <= g < sum(dealt[int(c)])]) for g in range(groups)]
    partitions = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // block), min(-(-n // LEAST), -(-2 * partitions // groups)))

    def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            m = _matrix(b.column(1), dim)
            need = needed(m)
            whole = pa.RecordBatch.from_arrays([b.column(0), _packed(m, kind), b.column(2)], ["vec_id", "v", "part"])
            for g, own in enumerate(of_group):  # a batch each, or the copies of a batch would be held at once
                some = whole.filter(pa.array(need[:, own].any(1)))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, g, np.int32)), *some.columns], ["bundle", "vec_id", "v", "part"])

    part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("part")
    right = data.select("vec_id", "v", part).mapInArrow(deal, "bundle int, vec_id long, v binary, part int")
    first, shares = (F.element_at(F.create_map(*[F.lit(x) for c, at in dealt.items() for x in (c, at[i])]), F.col("cell")) for i in range(2))
    own = (first + F.pmod(F.xxhash64("query_id", "v"), shares.cast("long"))).cast("int").alias("bundle")
    left = located.select(own, "query_id", "v", "cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not q.num_rows or not x.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        q, x = q.sort_by("cell"), x.sort_by("vec_id")
        ids, asked_ids = x["vec_id"].to_numpy(), q["query_id"].to_numpy()
        data_, queries_ = _unpacked(x["v"], dim, kind), _unpacked(q["v"], dim, kind)
        cell = np.searchsorted(cells, q["cell"].to_numpy())
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        best = _Best(len(cell), k)
        for at in range(0, len(ids), PIECE):
            piece, piece_ids = data_[at : at + PIECE], ids[at : at + PIECE]
            need = needed(piece.astype(np.float64))
            piece = piece.astype(exact)
            for a, b in zip(edges[:-1], edges[1:]):
                some = need[:, cell[a]]
                if not some.any():
                    continue
                v, v_ids = (piece, piece_ids) if some.all() else (piece[some], piece_ids[some])
                for i in range(a, b, ROWS):
                    mine = asked_ids[i : min(i + ROWS, b)]
                    scores = queries_[i : i + len(mine)].astype(exact) @ v.T
                    begin, end = np.searchsorted(v_ids, mine, "left"), np.searchsorted(v_ids, mine, "right")
                    for row in np.flatnonzero(end > begin).tolist():
                        scores[row, begin[row] : end[row]] = -np.inf
                    best.add(i, scores, v_ids)
        hit = ~np.isneginf(best.score)
        found = [np.broadcast_to(asked_ids[:, None], hit.shape)[hit], best.id[hit], best.score[hit].astype(np.int64)]
        give_back()
        return pa.table(dict(zip(names, found)))

    # Tasks are dealt out by number: adaptive execution would put many into one by their bytes, but their work is in the products.
    tasks = max(partitions, min(groups * blocks, 10_000))
    sides = [df.repartition(tasks, "bundle", "part").groupBy("bundle", "part") for df in (left, right)]
    found = sides[0].cogroup(sides[1]).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
