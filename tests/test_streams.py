"""Streams give the batch result."""

from pyspark.sql import functions as F

from daftar.streaming import flows


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    for i in (1, 2):
        write(spark, src, [(i,)], "id int")
        flows.ingest_stream(flows.table_stream(spark, str(src), "*.parquet"), out, ck).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_table_that_is_a_folder_of_files(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "pages.parquet"))
    stream = flows.table_stream(spark, str(tmp_path), "documents.parquet")
    assert sorted(r.id for r in flows.run_to_table(stream, "whole").collect()) == list(range(40))
    part = next((tmp_path / "pages.parquet").glob("part-*.parquet"))
    one = flows.table_stream(spark, str(part.parent), part.name)  # a table that is a file
    assert set(r.id for r in flows.run_to_table(one, "one").collect()) == set(r.id for r in spark.read.parquet(str(part)).collect())


def test_pdf_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF")
    out = str(tmp_path / "out")
    flows.ingest_stream(flows.file_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "ck")).awaitTermination()
    assert [(r.filename, r.status) for r in spark.read.parquet(out).collect()] == [("a.pdf", "pending")]


def test_upsert_over_batches(spark, tmp_path):
    src, path, ck = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "ck")
    for rows in ([("a", 1), ("b", 1)], [("a", 2)], [("b", 0), ("c", 3)]):
        write(spark, src, rows, "k string, version int")
        stream = flows.table_stream(spark, str(src), "*.parquet")
        flows.stream_upsert(stream, path, ck, ["k"], [F.col("version").desc()]).awaitTermination()
    order = [F.col("version").desc()]
    flows.compact(spark, path, path + "-2", ["k"], order)
    assert flows.upserted(spark, path + "-2", ["k"], order).count() == 3
    got = {r.k: r.version for r in flows.upserted(spark, path, ["k"], order).collect()}
    assert got == {"a": 2, "b": 1, "c": 3}


def test_claim_timeout_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "chunk_id int, status string, ts timestamp"

    def at(minute):
        import datetime

        return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)

    first = [(1, "processing", at(0)), (2, "processing", at(1)), (2, "done", at(5)), (3, "processing", at(2)), (3, "done", at(20))]
    second = [(4, "processing", at(30)), (1, "done", at(31)), (5, "done", at(60))]
    # The later rows come first; the last file lets the watermark pass all others.
    last = [(6, "done", at(300))]
    for rows in (second, first, last):
        write(spark, src, rows, schema)
    batch = spark.createDataFrame(first + second + last, schema)
    want = sorted((r.chunk_id, r.claimed_at) for r in flows.expired_claims(batch).collect())
    stream = flows.table_stream(spark, str(src), "*.parquet", files_per_trigger=1)
    got = sorted((r.chunk_id, r.claimed_at) for r in flows.run_to_table(flows.stream_claim_timeout(stream, delay="6 hours"), "late").collect())
    assert got == []  # nothing is certain yet
    got = sorted((r.chunk_id, r.claimed_at) for r in flows.run_to_table(flows.stream_claim_timeout(stream, delay="3 hours"), "claims").collect())
    assert got == want == [(1, at(0)), (3, at(2)), (4, at(30))]


def test_watermarked_dedup(spark, tmp_path):
    write(spark, tmp_path / "in", [("a", 1), ("a", 2), ("b", 3)], "content_hash string, s int")
    stream = flows.table_stream(spark, str(tmp_path / "in"), "*.parquet").withColumn("ts", F.timestamp_seconds("s"))
    out = flows.run_to_table(flows.stream_dedup(stream, ["content_hash"], "ts", "1 hour"), "dedup")
    assert sorted(r.content_hash for r in out.collect()) == ["a", "b"]


STEPS = "job_id int, status string, ts timestamp, event_id long"


def _job_rows():
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    good = ["pending", "extracting", "chunking", "quality_scan", "repairing", "embedding", "completed"]
    rows = [(1, s, at(i), i) for i, s in enumerate(good)]
    rows += [(2, "pending", at(0), 20), (2, "chunking", at(1), 21), (2, "extracting", at(1), 22), (2, "failed", at(2), 23), (2, "embedding", at(3), 24), (2, "pending", at(4), 25)]
    rows += [(3, "extracting", at(0), 30), (3, None, at(1), 31), (3, "nonsense", at(2), 32), (3, "pending", at(3), 33)]
    return rows, [(9, "pending", at(600), 99)]


def test_job_steps_out_of_order(spark, tmp_path):
    """Rows of one job in three files, last ones first: the same steps as in order; what is not legal changes no state."""
    rows, end = _job_rows()
    for part in (rows[2::3], rows[1::3], rows[::3], end):
        write(spark, tmp_path / "in", part, STEPS)
    stream = flows.table_stream(spark, str(tmp_path / "in"), "*.parquet", files_per_trigger=1)
    steps = flows.run_to_table(flows.stream_job_steps(stream, delay="1 hour"), "steps")
    got = sorted((r.job_id, r.tie, r.previous, r.legal) for r in steps.collect())
    want, state = [], {}
    for job, status, _, tie in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        legal = flows.legal_step(state.get(job), status)
        want.append((job, tie, state.get(job), legal))
        state[job] = status if legal else state.get(job)
    assert got == sorted(want)
    assert [(j, t) for j, t, _, legal in got if not legal] == [(2, 21), (2, 24), (3, 30), (3, 31), (3, 32)]
    assert {r.job_id: r.status for r in flows.current_states(steps).collect()} == {1: "completed", 2: "pending", 3: "pending"}


def test_job_steps_go_on_after_a_restart(spark, tmp_path):
    """A second run over the same checkpoint starts from the stored states and tells no step twice."""
    rows, end = _job_rows()
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for part in (rows[:9], rows[9:], end):
        write(spark, tmp_path / "in", part, STEPS)
        steps = flows.stream_job_steps(flows.table_stream(spark, src, "*.parquet"), delay="1 hour")
        flows.ingest_stream(steps, out, mark).awaitTermination()
    told = spark.read.parquet(out)
    assert told.count() == len(rows) == told.select("job_id", "tie").distinct().count()
    assert {r.job_id: r.status for r in flows.current_states(told).collect()} == {1: "completed", 2: "pending", 3: "pending"}


class _State:
    """A value or list state that counts how often it is read and written."""

    def __init__(self):
        self.rows, self.reads, self.writes = [], 0, 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.reads += 1
        return iter(self.rows) if isinstance(self, _ListState) else self.rows[0]

    def update(self, row):
        self.rows, self.writes = [row], self.writes + 1

    def clear(self):
        self.rows = []


class _ListState(_State):
    def appendList(self, rows):
        self.rows, self.writes = [*self.rows, *rows], self.writes + 1

    def put(self, rows):
        self.rows, self.writes = list(rows), self.writes + 1


class _Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return _State()

    def getListState(self, *_):
        return _ListState()

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_rows_ahead_of_the_watermark_are_only_appended():
    import pandas as pd

    at = lambda s: pd.to_datetime(pd.Series(s, dtype="int64"), unit="s")
    jobs = flows.JobStates()
    jobs.init(_Handle())
    frames = [pd.DataFrame({"ts": at([30, 20]), "tie": [1, 2], "status": ["extracting", "pending"]}), pd.DataFrame({"ts": at([40]), "tie": [3], "status": ["completed"]})]
    for frame in frames:
        assert not [f for f in jobs.handleInputRows((5,), iter([frame]), _Clock(0)) if len(f)]
    assert jobs.waiting.reads == 0 and jobs.waiting.writes == 2 and jobs.handle.timers == {20_000}
    told = pd.concat(jobs.handleExpiredTimer((5,), _Clock(35_000), None))
    assert list(zip(told["status"], told["legal"])) == [("pending", True), ("extracting", True)] and jobs.handle.timers == {40_000}
    told = pd.concat(jobs.handleExpiredTimer((5,), _Clock(41_000), None))
    assert list(zip(told["status"], told["legal"])) == [("completed", False)] and not jobs.handle.timers and not jobs.waiting.rows

    claims = flows.ClaimTimeout(10)
    claims.init(_Handle())
    frame = pd.DataFrame({"ts": at([2000, 60]), "status": ["done", "processing"]})
    assert not [f for f in claims.handleInputRows((7,), iter([frame]), _Clock(0)) if len(f)] and claims.waiting.reads == 0
    told = pd.concat(claims.handleExpiredTimer((7,), _Clock(700_000), None))
    assert list(told["claimed_at"]) == [pd.Timestamp(60, unit="s")] and claims.handle.timers == {2_000_000}
