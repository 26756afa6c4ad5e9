"""A keyed table fed by a stream, kept as runs of batches in levels.

Batch ``n`` is written as the run ``n-n``, in ranges of its key.  When ``fan`` runs of a level are
complete they are merged into one of the next, so a reader opens at most ``fan - 1`` runs
per level, and a row is rewritten once per level.  A run counts once its writer has left ``_SUCCESS``
(Spark's default) and takes the place of the runs it covers.  These stay until the next merge, for readers
that have listed them.  Runs are named after batches, so a repeated batch writes the same
names; one that a merged run holds already is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators.skew import keep_first
from daftar.sources.keyed_store import at

FAN = 8


def runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first batch, last batch) of every complete run, in order, wider ones first."""
    folder, files = at(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    done = [n for n in names if "-" in n and files.exists(at(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted((tuple(map(int, n.split("-"))) for n in done), key=lambda r: (r[0], -r[1]))


def live(found: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that no wider one covers."""
    out: list[tuple[int, int]] = []
    for first, last in found:
        if not out or last > out[-1][1]:
            out.append((first, last))
    return out


def _read(spark: SparkSession, path: str, chosen: Sequence[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{first}-{last}" for first, last in chosen])


def _write(rows: DataFrame, path: str, run: tuple[int, int], key: Sequence[str]) -> None:
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    ranged.write.mode("overwrite").parquet(f"{path}/{run[0]}-{run[1]}")


def _newest(rows: DataFrame, key: Sequence[str], version: Sequence[Column]) -> DataFrame:
    return keep_first(rows, key, [*version, F.col("_batch").desc()])


def merged_run(batch: int, fan: int) -> tuple[int, int] | None:
    """The widest run that ``batch`` completes."""
    span = 1
    while (batch + 1) % (span * fan) == 0:
        span *= fan
    return (batch + 1 - span, batch) if span > 1 else None


def write_batch(rows: DataFrame, path: str, batch: int, key: Sequence[str], version: Sequence[Column], fan: int = FAN) -> None:
    """Record a batch's latest row per key; merge and clear what it completes."""
    spark = rows.sparkSession
    found = runs(spark, path)
    if any(first <= batch <= last and first < last for first, last in found):
        return
    _write(keep_first(rows, key, version).withColumn("_batch", F.lit(batch).cast("long")), path, (batch, batch), key)
    whole = merged_run(batch, fan)
    if whole is None:
        return
    parts = [r for r in live(runs(spark, path)) if whole[0] <= r[0]]
    _write(_newest(_read(spark, path, parts), key, version), path, whole, key)
    for run in set(found) - set(live(found)):
        folder, files = at(spark, f"{path}/{run[0]}-{run[1]}")
        files.delete(folder, True)


def read(spark: SparkSession, path: str, key: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """Latest version per key; of equal versions the later batch's row."""
    return _newest(_read(spark, path, live(runs(spark, path))), key, version).drop("_batch")


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], version: Sequence[Column], fan: int = FAN):
    """Keep the table under ``path`` up to date with a stream, all present input at once."""
    return (
        stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, path, batch, key, version, fan))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
