"""Session set-up and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import gc
import shutil
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", own_folder())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def own_folder() -> str:
    """A folder on this machine for a local session, removed when the program ends."""
    folder = f"/tmp/millrace-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, a session on this machine alone takes one of
    its own; on a cluster that is an error, as executors could not read a folder of the driver's machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        return current.get()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = own_folder()
    if not current.isDefined():
        sc.setCheckpointDir(folder)
    return folder


def named_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for a table that is to be read again by its path."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage; survives lost executors. The files go
    with the last reference to the table where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written as a parquet table of its own folder in the shared one, and read back: for tables that compress well,
    or of whose columns later steps read few. It stays until clear_tables."""
    path = named_folder(df.sparkSession, name)
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for files of tasks, as a URI. It stays until clear_tables."""
    path = named_folder(spark, name)
    _tables.append(path)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


@contextmanager
def swept(spark: SparkSession, seconds: float = 5) -> Iterator[None]:
    """Collects the driver's garbage now and every few seconds within: shuffle files of ended steps go with the last
    reference to them, and a library's rounds leave many before the driver's memory is short."""
    done, collect = threading.Event(), spark._jvm.System.gc

    def run() -> None:
        while not done.wait(seconds):
            collect()

    gc.collect()
    collect()
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


_tables: list[str] = []


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables that this program has materialised, once no result that reads them is still to be computed."""
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
