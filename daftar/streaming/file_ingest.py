"""Files taken in as they arrive, with an outcome per file.

The stream's checkpoint says which files a batch holds, so each file is taken once, restarts included.  A file
is parsed whole in its task; one that fails is tried again there, then recorded as ``error``
and set aside, and the others go on.  Rows and outcomes are written under the batch's number, from
one stored attempt, so a repeated batch overwrites both.  With ``archive`` Spark moves files to that
folder once the batch after theirs has begun.  Files without a byte carry nothing and have no
outcome: Spark's file source passes over them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.session import durable, release, tracked
from daftar.sources.keyed_store import at

ATTEMPTS = 3
#: (path, content) -> rows of the asked schema, as tuples.
Parse = Callable[[str, bytes], list[tuple]]


def arriving(spark: SparkSession, folder: str, pattern: str = "*", per_batch: int = 1000, archive: str | None = None) -> DataFrame:
    """Stream of (path, content) of the files below ``folder``."""
    reader = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select("path", "content")


def tried(files: DataFrame, parse: Parse, schema: str, attempts: int = ATTEMPTS) -> DataFrame:
    """(path, status, attempts, error, rows) of each file; an error is a value, not a failed task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows, error, n = [], None, 0
                while n < attempts:
                    n += 1
                    try:
                        rows, error = parse(path, content), None
                        break
                    except Exception as failure:  # whatever a parser raises belongs to its file
                        error = f"{type(failure).__name__}: {failure}"[:500]
                status = "error" if error else "done"
                yield pd.DataFrame({"path": [path], "status": [status], "attempts": [n], "error": [error], "rows": [[dict(zip(names, r)) for r in rows]]})

    names = files.sparkSession.createDataFrame([], schema).columns
    return files.mapInPandas(run, f"path string, status string, attempts int, error string, rows array<struct<{_fields(files, schema)}>>")


def _fields(files: DataFrame, schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in files.sparkSession.createDataFrame([], schema).schema)


def set_aside(failed: DataFrame, folder: str) -> None:
    """Move files to ``folder``, under their name and the hash of their path; those moved before stay moved."""
    spark = failed.sparkSession
    target, files = at(spark, folder)
    files.mkdirs(target)
    for row in failed.select("path", F.md5("path").alias("hash")).toLocalIterator():
        source, files = at(spark, row["path"])
        if files.exists(source):
            files.rename(source, at(spark, f"{folder}/{row['hash'][:12]}-{source.getName()}")[0])


def ingest_files(stream: DataFrame, parse: Parse, schema: str, out: str, checkpoint: str, aside: str | None = None, attempts: int = ATTEMPTS):
    """Rows to ``out/rows``, outcomes to ``out/log``; all present input, then the query ends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with tracked() as paths:
            seen = durable(tried(batch, parse, schema, attempts), "tried")
            seen.select("path", F.inline("rows")).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")
            outcome = seen.select("path", "status", "attempts", "error", F.size("rows").alias("n_rows"))
            outcome.write.mode("overwrite").parquet(f"{out}/log/batch_id={batch_id}")
            if aside:
                set_aside(seen.filter("status = 'error'"), aside)
            release(batch.sparkSession, paths)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
