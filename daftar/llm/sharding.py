"""Sharding by sampled splitters.

Records are laid in the order of a key, and the key's order is cut into ranges:

1. draw a sample of keys, each with a chance in proportion to its size;
2. the sample's quantiles are the splitters, and records are dealt to the ranges
   between them;
3. ranges that turn out to be overfull are divided again, by a sample of their own;
4. prefix sums over the ranges, and inside each range, give every record's place
   in the whole order; a shard is an equal share of the bytes.

The key is (hash of the text, doc_id, checksum): equal texts are neighbours, and
a group of any size is divided by id like any other range.  The number of
splitters follows the rows up to a parameter, and the sample follows it.

Nulls and edge cases: a null text has size 16 like an empty one, but its checksum
is null; a null ``doc_id`` sorts first; rows alike in every key column share a
range and are numbered in any order, which changes nothing in the result; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.common import durable

SHARDS = 40
#: Overhead of a record, in bytes.
OVERHEAD = 16
#: Splitters at most, and keys drawn per splitter, on average.
SPLITTERS, OVERSAMPLE = 10_000, 20
#: A range with more than this many times its share of rows or bytes is divided, in so many rounds at most.
OVERFULL, ROUNDS = 4, 3
#: Rows that a range may hold whatever its share.
SMALL = 20_000


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group): what the sharding needs of each document."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("group"),
    )


def _draw(rows: DataFrame, per_byte: float, salt: int) -> np.ndarray:
    """Keys of a sample with a chance of size * per_byte each, sorted; (group, doc_id) pairs."""
    dice = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "group", "doc_id", "text_crc32"), 11) / F.lit(float(1 << 53))
    got = rows.filter(dice < F.col("size") * F.lit(per_byte)).select("group", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")).toPandas()
    keys = np.array(list(zip(got["group"], got["doc_id"])), [("g", "<i8"), ("d", "<i8")])
    keys.sort()
    return keys


def _dealt(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``rows`` with the number of their range: splitters at or below their key."""
    g, d = splitters["g"].copy(), splitters["d"].copy()

    @F.pandas_udf("int")
    def range_of(group: pd.Series, doc: pd.Series) -> pd.Series:
        a, b = group.to_numpy(), doc.to_numpy()
        low, high = np.searchsorted(g, a, "left"), np.searchsorted(g, a, "right")
        for i in np.flatnonzero(low < high):  # the group itself is divided
            low[i] += np.searchsorted(d[low[i] : high[i]], b[i], "right")
        return pd.Series(low.astype(np.int32))

    return rows.withColumn("range", range_of("group", F.coalesce("doc_id", F.lit(-(1 << 63)))))


def ranges(rows: DataFrame, splitters: int = SPLITTERS, rounds: int = ROUNDS) -> tuple[DataFrame, pd.DataFrame]:
    """``rows`` with ``range``, and rows and bytes of each range."""
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    want = max(1, min(splitters, -(-n // (SMALL // 4))))
    sample = OVERSAMPLE * want
    keys = _draw(rows, sample / max(total or 1, 1), 0)
    cuts = np.unique(keys[np.linspace(0, len(keys), want, endpoint=False).astype(int)[1:]]) if len(keys) else keys
    for r in range(rounds + 1):
        dealt = _dealt(rows, cuts)
        sizes = dealt.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).toPandas()
        share, part = max(n / (len(cuts) + 1) * OVERFULL, SMALL), max(total or 1, 1) / (len(cuts) + 1) * OVERFULL
        over = sizes[(sizes["rows"] > share) | ((sizes["bytes"] > part) & (sizes["rows"] > SMALL))]
        if over.empty or r == rounds:
            return dealt, sizes
        # Rows count as much as bytes here: many small records are overfull, too.
        inside = dealt.filter(F.col("range").isin([int(x) for x in over["range"]])).withColumn("size", F.col("size") + F.lit(max((total or 0) // max(n, 1), 1)))
        more = _draw(inside, sample / float(over["bytes"].sum() + over["rows"].sum() * max((total or 0) // max(n, 1), 1)), r + 1)
        step = max(1, len(more) // max(1, int(-(-over["rows"].sum() // (SMALL // 4)))))
        cuts = np.unique(np.concatenate([cuts, more[::step]]))
    raise AssertionError("unreachable")


def shard(docs: DataFrame, shards: int = SHARDS, splitters: int = SPLITTERS) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) of every document.

    Shard s holds the records whose middle byte lies in the s-th equal share of
    all bytes, so shards differ by no more than the sizes at their two borders.
    """
    rows = durable(records(docs), "records")
    dealt, sizes = ranges(rows, splitters)
    sizes = sizes.sort_values("range")
    total, starts = int(sizes["bytes"].sum()), {}
    at_bytes = at_rows = 0
    for r, n, b in zip(sizes["range"], sizes["rows"], sizes["bytes"]):
        starts[int(r)] = (at_bytes, at_rows)
        at_bytes, at_rows = at_bytes + int(b), at_rows + int(n)
    spark = docs.sparkSession
    offsets = spark.createDataFrame([(k, *v) for k, v in starts.items()], "range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy("group", "doc_id", "text_crc32", "size")
    placed = dealt.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_bytes"),
        (F.row_number().over(inside) - 1).alias("_rows"),
    ).join(offsets, "range")
    # Twice the middle, to stay in whole numbers.
    middle = 2 * (F.col("bytes_before") + F.col("_bytes")) + F.col("size")
    number = F.least(F.floor(middle * F.lit(shards) / F.lit(2 * max(total, 1))), F.lit(shards - 1)).cast("int")
    ordered = durable(placed.select("doc_id", "size", "text_crc32", "group", number.alias("shard"), (F.col("rows_before") + F.col("_rows")).alias("_rank")), "ranked")
    first = ordered.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row per shard
    return ordered.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_rank") - F.col("_first")).cast("long")).drop("_rank", "_first")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the documents as one folder per shard, in slot order inside each file; returns the assignment.

    ``docs`` must have unique ids.  A shard of any size is written by several tasks.
    """
    placed = durable(shard(docs, shards), "placed")
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange(max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed
