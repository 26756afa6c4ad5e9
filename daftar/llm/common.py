"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar import session

#: The characters that separate words: space and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE]] = True


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    A lost executor then re-reads files instead of repeating the work, and every
    later branch sees the same rows.
    """
    return session.durable(df, f"llm-{name}")


#: Bytes of a batch that goes to a Python worker, at most (Spark's default is 64 MB), unless one row is larger.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what Spark and each Python worker hold of long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: How to drop what operators keep in a Python worker from task to task; a module that keeps something adds to it.
KEPT: list[Callable[[], None]] = []


def give_back() -> None:
    """Return freed memory of this Python worker to the system; allocators hold on to it otherwise, and Spark reuses workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean_worker() -> None:
    """Drop what other operators' tasks have left in this Python worker; their next task makes it again."""
    for drop in KEPT:
        drop()
    give_back()


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_in(text: Column) -> Column:
    """Words in order, without empty strings; null stays null."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name += "_"
    return name


def batches(batch: pa.RecordBatch, text: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``limit`` text bytes.

    Yields first row, row after the last, the bytes, and each row's first byte
    (one more entry than rows).  A null is an empty text.
    """
    col = batch.column(text)
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offs else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def word_starts(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, number of the first word of each row and of the end, white-space mask)."""
    space = _IS_SPACE[raw]
    begin = np.empty(len(raw), bool)
    if len(raw):
        begin[0] = True
        begin[1:] = space[:-1]
        inner = offs[:-1][offs[:-1] < len(raw)]
        begin[inner] = True
        begin &= ~space
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offs), space


def kth_key(df: DataFrame, key: str, k: int, fan: int = 1024) -> float | None:
    """The k-th largest value of a double column, without sorting.

    Each round counts the rows of ``fan`` equal intervals and goes on inside the
    one that holds the k-th value, until the interval holds nothing but copies
    of one value.  What comes to the driver is one row per interval at most.
    None if there are fewer than ``k`` values, or ``k`` is below 1.
    """
    df = df.select(F.col(key).cast("double").alias("x")).filter(F.col("x").isNotNull())
    lo, hi, n = df.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k < 1 or n < k:
        return None
    left = k
    while lo < hi:
        step = (hi - lo) / fan
        if lo + step == lo or hi - step == hi:
            break
        cell = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(step)), F.lit(fan - 1))
        inside = df.filter((F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi)))
        cells = inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for row in sorted(cells, key=lambda r: -r["c"]):
            if row["n"] >= left:
                lo, hi = row["lo"], row["hi"]
                break
            left -= row["n"]
    return float(hi)


def numbered(df: DataFrame, order: list[Column], name: str, parts: int) -> DataFrame:
    """Number all rows from 0 in ``order``: range partitions, their counts, a window in each.

    The partition of a row is written with it, so that the numbers hold when a
    task runs again.  Rows that ``order`` can't tell apart share a partition.
    """
    cut = durable(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut.withColumn("_rank", rank).join(offsets, "_part").withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_part", "_rank", "_before")


def parts_for(spark: SparkSession, rows: int, per_part: int = 50_000) -> int:
    return max(1, -(-rows // per_part), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 1000))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on the node that asks."""
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))
