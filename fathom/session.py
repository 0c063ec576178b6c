"""Session helpers: a local session for tests and tools, and tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dirs: list[str] = []
_shipped: set[str] = set()
_stored: dict[tuple, tuple] = {}
_passing: ContextVar[str | None] = ContextVar("_passing", default=None)  # of this thread only


def get_spark(cores: str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session; on a cluster, use the session that spark-submit gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fathom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or of the context's checkpoints; a temporary one for local sessions only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.mkdtemp(prefix="fathom-"))
        atexit.register(shutil.rmtree, _own_dirs[0], ignore_errors=True)
    return f"file://{_own_dirs[0]}"


def _context_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what follows no longer depends on shuffle files of executors that may be lost.
    """
    path = f"{_passing.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``write_table`` writes within is deleted at the end, and shuffle files as soon as a table is written.

    For batches whose results are collected; ``stored`` tables stay.
    """
    folder, cleanup = f"{shared_dir(spark)}/passing-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    token = _passing.set(folder)
    try:
        yield
    finally:
        _passing.reset(token)
        if before is None:
            spark.conf.unset(cleanup)
        else:
            spark.conf.set(cleanup, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build()``, written once per application and state of the tables in ``folder``, then read.

    For indexes that many queries share. Written anew where its files are gone or the tables have changed.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path(folder))
    state = max((f.getModificationTime() for f in files), default=0)
    key = (spark.sparkContext.applicationId, folder, name, state)
    known = _stored.get(key)
    if known is not None:
        done = fs_path(f"{known[0]}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return spark.read.schema(known[1]).parquet(known[0])
    table = build()
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    _stored[key] = (path, table.schema)
    return spark.read.schema(table.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once per application."""
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="fathom-code-"), "fathom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith((".py", ".txt")):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("fathom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files come as fewer partitions; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
