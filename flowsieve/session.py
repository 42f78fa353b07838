"""Session helpers: test session, and tables written to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "flowsieve", **conf) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    Taken from `spark.checkpoint.dir`, or from the checkpoint folder the
    application has set. Only a local master may go without either, since a
    folder of one machine is lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowsieve-"))
    return spark.sparkContext.getCheckpointDir()


_paths: list[str] = []
_blocks = threading.local()  # of each thread, the tables of its open `own_tables` blocks


def new_table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    open_blocks = getattr(_blocks, "open", [])
    (open_blocks[-1] if open_blocks else _paths).append(path)
    return path


def release_tables(spark: SparkSession) -> int:
    """Delete the tables this process has written, but for those of open blocks; returns how many there were.

    For use once the results that read them have been stored.
    """
    released = 0
    while _paths:
        released += delete_path(spark, _paths.pop())
    return released


@contextlib.contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes in the block are deleted at its end, also if it fails; all others stay.

        with own_tables(spark):
            dedupe_scoped_fifo(view).write.parquet(target)
    """
    if not hasattr(_blocks, "open"):
        _blocks.open = []
    _blocks.open.append([])
    try:
        yield
    finally:
        for path in _blocks.open.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it is; False if there was none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def age_by_name(spark: SparkSession, path: str) -> None:
    """Give the files of a written table times that follow their names, one after the other.

    A file stream admits the oldest files first; tasks end in any order. Only the
    names and times pass the driver, which lists them for the stream anyway.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def parts():
        found = [f for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")]
        return sorted(found, key=lambda f: f.getPath().getName())

    files = parts()
    latest = max((f.getModificationTime() for f in files), default=0)
    for place, f in enumerate(files):
        store.setTimes(f.getPath(), latest - 10 * (len(files) - place), -1)
    times = [f.getModificationTime() for f in parts()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise OSError(f"the store of {path} does not keep file times; replay from one that does")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Unlike a cached frame this survives the loss of executors, keeps column
    pruning and filter pushdown, and freezes values that depend on the physical
    layout (row numbers per partition).
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
