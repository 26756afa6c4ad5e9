"""The polling loops of the application as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from daftar.session import scratch_path
from daftar.operators.skew import keep_first

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet tables in ``folder`` whose name fits ``pattern``, each a file or a folder of files."""
    # Braces make any name a pattern: the stream takes a plain path for a folder, even if it is a file.
    found = f"{folder}/{{{pattern}}}"
    reader = spark.readStream.schema(spark.read.parquet(found).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(found)


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New PDF files as they arrive; names and sizes, not bytes."""
    from daftar.sources.files import listing

    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.pdf")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    return listing(raw)


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, interval: str | None = None):
    """Append a stream to a table; the checkpoint is the record of what is done.

    Without ``interval`` everything present is taken and the query ends.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start(out)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all present input and return what it wrote.

    Update and complete modes write one folder per batch, so a repeated batch
    overwrites its own output; the batch number is kept in ``batch_id``.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    if mode == "append":
        ingest_stream(stream, path, checkpoint).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.option("basePath", path).parquet(path)


def stream_dedup(stream: DataFrame, key: Sequence[str], at: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once.  With ``delay`` keys are forgotten once they are that old."""
    if at and delay:
        return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))
    return stream.dropDuplicates(list(key))


_EPOCH = datetime(1970, 1, 1)


def _watermark(timerValues) -> datetime:
    return _EPOCH + timedelta(milliseconds=timerValues.getCurrentWatermarkInMs())


def _times(column: pd.Series) -> list[datetime]:
    return column.array.to_pydatetime().tolist()


def _wake(handle: StatefulProcessorHandle, times: list[datetime]) -> None:
    """Leave one timer, at the earliest of ``times``, or none; it fires once the watermark is past it and counts in whole milliseconds."""
    at = min(-((_EPOCH - t) // timedelta(milliseconds=1)) for t in times) if times else None
    known = list(handle.listTimers())
    for timer in known:
        if timer != at:
            handle.deleteTimer(timer)
    if at is not None and at not in known:
        handle.registerTimer(at)


def _laid_by(processor, new: list, timerValues) -> bool:
    """Append rows that are all ahead of the watermark to those that wait; what waits is neither read nor written again.

    Waiting rows that are due have a timer that fires in this batch.
    """
    now = _watermark(timerValues)
    if not new or any(not row[0] > now for row in new):
        return False
    processor.waiting.appendList([(*row[:-1], row[-1] or "") for row in new])
    first = -((_EPOCH - min(row[0] for row in new)) // timedelta(milliseconds=1))
    if not any(timer <= first for timer in processor.handle.listTimers()):
        processor.handle.registerTimer(first)
    return True


def _keep(waiting, later: list, kept: list) -> None:
    if later:
        waiting.put(later)
    elif kept:
        waiting.clear()


class ClaimTimeout(StatefulProcessor):
    """Per chunk: a claim not followed by another event in time is given back.

    Rows may come in any order within the watermark's delay: they wait, one by
    one, in the state until the watermark has passed them, and are then taken in
    the order of their times.  What waits per chunk is bounded by the delay.
    """

    def __init__(self, minutes: int) -> None:
        self.limit = timedelta(minutes=minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "claimed_at timestamp")
        self.waiting = handle.getListState("waiting", "ts timestamp, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [row for frame in rows for row in zip(_times(frame["ts"]), frame["status"])]
        if not _laid_by(self, new, timerValues):
            yield from self._advance(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues, [])

    def _advance(self, key, timerValues, new: list) -> Iterator[pd.DataFrame]:
        """Take all rows up to the watermark; tell the claims that ran out on the way."""
        now = _watermark(timerValues)
        kept = list(self.waiting.get()) if self.waiting.exists() else []
        before = self.claim.get()[0] if self.claim.exists() else None
        held, later, expired = before, [], []
        for ts, status in sorted((ts, status or "") for ts, status in [*kept, *new]):
            if ts > now:
                later.append((ts, status))
                continue
            if held is not None and ts > held + self.limit:
                expired.append(held)
            held = ts if status == "processing" else None
        if held is not None and held + self.limit <= now:
            expired.append(held)
            held = None
        _keep(self.waiting, later, kept)
        if held != before:
            self.claim.update((held,)) if held is not None else self.claim.clear()
        _wake(self.handle, [ts for ts, _ in later[:1]] + ([held + self.limit] if held is not None else []))
        if expired:
            yield self._released(key, expired)

    def _released(self, key, claims) -> pd.DataFrame:
        return pd.DataFrame({
            "chunk_id": pd.Series([key[0]] * len(claims), dtype="int64" if isinstance(key[0], int) else object),
            "claimed_at": pd.to_datetime(pd.Series(claims, dtype="datetime64[us]")),
            "status": pd.Series(["pending"] * len(claims), dtype=object),
        })

    def close(self) -> None:
        pass


def stream_claim_timeout(stream: DataFrame, minutes: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Claims returned to pending: stream(chunk_id, status, ts) in event time.

    The claim expires when the watermark has passed the timeout and no event of
    the chunk lies between; rows later than ``delay`` are dropped.  Needs the
    RocksDB state store.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    key = stream.schema["chunk_id"].dataType.simpleString()
    return (
        stream.withWatermark("ts", delay)
        .groupBy("chunk_id")
        .transformWithStateInPandas(
            statefulProcessor=ClaimTimeout(minutes),
            outputStructType=f"chunk_id {key}, claimed_at timestamp, status string",
            outputMode="append",
            timeMode="eventTime",
        )
    )


def expired_claims(events: DataFrame, minutes: int = 10, width: int = 86_400) -> DataFrame:
    """Batch twin: claims whose next event comes after the timeout, or never
    although the log goes on past it."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    limit = minutes * 60_000_000
    log = events.withColumn("_at", at).withColumn("_back", -at)
    from daftar.operators.skew import previous_value

    log = previous_value(log, ["chunk_id"], F.col("_back") / 1_000_000, [F.col("_back")], "_at", "_next", width)
    newest = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    late = F.when(F.col("_next").isNull(), newest - F.col("_at") >= limit).otherwise(F.col("_next") - F.col("_at") > limit)
    return log.filter((F.col("status") == "processing") & late).select(
        "chunk_id", F.col("ts").alias("claimed_at"), F.lit("pending").alias("status")
    )


def stream_status_counts(stream: DataFrame, status: str = "status") -> DataFrame:
    return stream.groupBy(F.coalesce(status, F.lit("null")).alias(status)).agg(F.count("*").alias("total"))


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], version: Sequence[Column]):
    """Record each batch's latest row per key under ``path``.

    A batch writes only its own rows, under its own number: repeating it after a
    failure overwrites the same folder, and the cost follows the batch, not the
    table.  ``upserted`` reads the table, ``compact`` folds the batches into one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_first(batch, key, version).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def upserted(spark: SparkSession, path: str, key: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The table ``stream_upsert`` keeps: latest version per key, later batches first."""
    rows = spark.read.option("basePath", path).parquet(path)
    return keep_first(rows, key, [*version, F.col("batch_id").desc()]).drop("batch_id")


def compact(spark: SparkSession, path: str, out: str, key: Sequence[str], version: Sequence[Column]) -> None:
    """Write the current table to ``out`` as the first batch of a new one."""
    upserted(spark, path, key, version).write.mode("overwrite").parquet(f"{out}/batch_id=-1")


def stream_job_state(stream: DataFrame, tie: str = "event_id") -> DataFrame:
    """Latest status per job; of rows at one time the one with the largest ``tie``."""
    return stream.groupBy("job_id").agg(F.max_by("status", F.struct("ts", tie)).alias("status"), F.max("ts").alias("ts"))


#: The order of a job's states; every state may also fail or be set back to pending.
JOB_STEPS = {
    "pending": ["extracting"], "extracting": ["ocr_running", "chunking"], "ocr_running": ["chunking"], "chunking": ["quality_scan"],
    "quality_scan": ["repairing"], "repairing": ["embedding"], "embedding": ["completed"], "completed": [], "failed": [],
}
JOB_ALWAYS = ["failed", "pending"]


def legal_step(now: str | None, status: str | None) -> bool:
    """Whether a job in state ``now`` may go to ``status``; a new job starts as pending."""
    if now is None:
        return status == "pending"
    return status in JOB_ALWAYS or status in JOB_STEPS[now]


class JobStates(StatefulProcessor):
    """Per job: takes its rows in the order of their times and checks each step.

    Rows wait in the state until the watermark has passed them, so the order in
    which they arrive does not matter within the delay.  A step that is not legal
    is told as such and leaves the job where it was.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string")
        self.waiting = handle.getListState("waiting", "ts timestamp, tie long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [row for frame in rows for row in zip(_times(frame["ts"]), frame["tie"].tolist(), frame["status"])]
        if not _laid_by(self, new, timerValues):
            yield from self._advance(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues, [])

    def _advance(self, key, timerValues, new: list) -> Iterator[pd.DataFrame]:
        upto = _watermark(timerValues)
        kept = list(self.waiting.get()) if self.waiting.exists() else []
        rows = sorted((ts, tie, status or "") for ts, tie, status in [*kept, *new])
        before = self.now.get()[0] if self.now.exists() else None
        now, told = before, []
        for ts, tie, status in rows:
            if ts > upto:
                break
            legal = legal_step(now, status)
            told.append((ts, tie, status, now, legal))
            now = status if legal else now
        later = rows[len(told) :]
        _keep(self.waiting, later, kept)
        if now != before:
            self.now.update((now,))
        _wake(self.handle, [ts for ts, *_ in later[:1]])
        if told:
            ts, tie, status, previous, legal = zip(*told)
            yield pd.DataFrame({
                "job_id": pd.Series([key[0]] * len(told), dtype="int64" if isinstance(key[0], int) else object),
                "ts": np.array(ts, "datetime64[us]"), "tie": np.array(tie, np.int64),
                "status": pd.Series(status, dtype=object), "previous": pd.Series(previous, dtype=object), "legal": np.array(legal, bool),
            })

    def close(self) -> None:
        pass


def stream_job_steps(stream: DataFrame, tie: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Every step of every job, checked: job_id, ts, tie, status, previous, legal.

    stream(job_id, ts, status and ``tie``, a number that orders rows of one time).  The legal
    rows are the jobs' states (``current_states``), the others the side output.  Rows later
    than ``delay`` are dropped; a null status is the empty one, which is never legal.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    key = stream.schema["job_id"].dataType.simpleString()
    rows = stream.select("job_id", "ts", F.col(tie).cast("long").alias("tie"), "status")
    return (
        rows.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
            statefulProcessor=JobStates(),
            outputStructType=f"job_id {key}, ts timestamp, tie long, status string, previous string, legal boolean",
            outputMode="append",
            timeMode="eventTime",
        )
    )


def current_states(steps: DataFrame) -> DataFrame:
    """The state each job has reached by legal steps."""
    return steps.filter("legal").groupBy("job_id").agg(F.max_by("status", F.struct("ts", "tie")).alias("status"), F.max("ts").alias("ts"))


def latest_updates(updates: DataFrame, key: str) -> DataFrame:
    """The last row per key out of the batches an update-mode stream wrote."""
    w = Window.partitionBy(key).orderBy(F.col("batch_id").desc())
    return updates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "batch_id")


def recent_activity(stream: DataFrame, minutes: int = 2, delay: str = "1 minute") -> DataFrame:
    """Pending rows per time window; rows later than ``delay`` are dropped."""
    pending = F.col("status").isNull() | (F.col("status") == "pending")
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.count_if(pending).alias("pending"))
        .select(F.col("w.start").alias("window_start"), "pending")
    )
