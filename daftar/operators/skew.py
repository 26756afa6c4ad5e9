"""Joins and running counts that stay spread out when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key.

    The rank filter becomes a WindowGroupLimit that runs before the shuffle, so
    a map task sends at most ``n`` rows of a key, however hot it is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def any_null(keys: Sequence[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def lookup_per_key(rows: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``rows`` to a table with one row per key, on the keys' own types.

    No rows are gathered per key here, so a hot key's partition can be split: the
    session's adaptive execution does that, and broadcasts ``per_key`` if it turns
    out small.
    """
    return rows.join(per_key, list(keys), "left").select(*rows.columns, *[c for c in per_key.columns if c not in keys])


def with_bucket(df: DataFrame, order: Column, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(order / F.lit(width)).cast("long"))


def running_index(
    df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[Column], name: str, width: int = 10_000
) -> DataFrame:
    """Number the rows of each key from 0 in ``order`` without one task per key.

    ``position`` is a number that ``order`` starts with.  Rows are numbered
    inside buckets of ``width`` positions; the bucket offsets come from a prefix
    sum over the much smaller table of bucket counts.
    """
    cut = with_bucket(df, position, width)
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*by)
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    numbered = cut.withColumn("_inside", inside)
    return (
        _same_keys(numbered, offsets, by)
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("int"))
        .drop("_offset", "_inside", "_bucket")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], position: Column, order: Sequence[Column], value: str, name: str, width: int = 10_000
) -> DataFrame:
    """The value of the row before, across bucket borders; null for the first row."""
    cut = with_bucket(df, position, width)
    by = [*keys, "_bucket"]
    last = cut.groupBy(*by).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))
    ).drop("_last")
    w = Window.partitionBy(*by).orderBy(*order)
    inside = cut.withColumn("_prev", F.lag(F.struct(value)).over(w))
    return (
        _same_keys(inside, carried, by)
        .withColumn(name, F.coalesce(F.col("_prev"), F.col("_carry"))[value])
        .drop("_prev", "_carry", "_bucket")
    )


def _same_keys(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the per-bucket row; plain equality keeps the window's partitioning."""
    return left.join(right, list(by), "left").select(
        *left.columns, *[c for c in right.columns if c not in by]
    )
