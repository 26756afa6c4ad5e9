"""Session settings and durable cut points."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Applied to a session that did not set them itself.  Joins carry no broadcast
# hints: Catalyst and AQE broadcast a side only after looking at its size, and
# split skewed shuffle partitions otherwise.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rank filters up to this many rows per key run before the shuffle (previews ask for 5,001).
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Bytes of a batch that goes to a Python worker, at most, unless one row is larger (Spark's default is 64 MB):
    # as pandas strings a batch takes a multiple of that, in every worker at once.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "daftar") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="daftar-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir`` of the session, or
    the one given to ``setCheckpointDir``.

    Only in local mode, where one machine does everything, a temporary folder
    stands in for it; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if re.match(r"local(\[|$)", context.master):
        return _own_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")


@functools.cache
def _package_zip() -> str:
    """The package as a zip in a temporary folder of the driver, from where Spark fetches it."""
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="daftar-code-"), "daftar.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if not name.endswith((".pyc", ".pyo")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("daftar", os.path.relpath(full, here)))
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package, whatever folder the driver started in."""
    context = spark.sparkContext
    if _shipped.get("to") != context.applicationId:
        context.addPyFile(_package_zip())
        _shipped["to"] = context.applicationId
    return spark


_shipped: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def durable(df: DataFrame, name: str = "stage", counts: dict[str, Column] | None = None, told: dict | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used before and after injected model calls: a lost executor re-reads the
    table instead of calling the model again, and every later branch sees the
    same rows.  ``counts``, aggregates by name, are observed while the rows are
    written and put into ``told`` under the stage's name; no row is read again for them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for paths in _tracking:
        paths.append(path)
    seen = Observation(f"{name}-{uuid.uuid4().hex}") if counts else None
    if seen:
        df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
    df.write.parquet(path)
    if seen:
        told[name] = {k: seen.get.get(k) or 0 for k in counts}
    return spark.read.parquet(path)


_tracking: list[list[str]] = []


@contextlib.contextmanager
def tracked() -> Iterator[list[str]]:
    """Collects the paths that ``durable`` writes meanwhile, for ``release``."""
    paths: list[str] = []
    _tracking.append(paths)
    try:
        yield paths
    finally:
        _tracking.remove(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``durable`` wrote, once what was made of them is stored."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
    paths.clear()
