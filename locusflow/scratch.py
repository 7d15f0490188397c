"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_scratch: dict[str, str] = {}
_writing = threading.Lock()
#: Of sessions with writes under way: how many, and the setting before the first.
_writers: dict[int, tuple[int, str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a local session gets a temporary folder; any other master is
    refused, because a machine-local folder would not be seen by the other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if configured:
        root = f"{configured.rstrip('/')}/locusflow-{app}"
        if app not in _own_scratch:  # what is still there when the application ends goes with it
            at = spark._jvm.org.apache.hadoop.fs.Path(root)
            fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
            fs.mkdirs(at)
            fs.deleteOnExit(at)
            _own_scratch[app] = root
        return root
    if app not in _own_scratch:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_scratch[app] = tempfile.mkdtemp(prefix="locusflow-")
        atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
    return f"file://{_own_scratch[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_end_with_queries(spark: SparkSession) -> Iterator[None]:
    """A stored result is read again from its table, so the shuffle files behind it needn't stay on the executors' disks.

    The setting is the session's: the first thread that writes sets it, the last one puts it back.
    """
    key = id(spark._jsparkSession)
    with _writing:
        depth, before = _writers.get(key) or (0, spark.conf.get(CLEANUP))
        _writers[key] = (depth + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _writing:
            depth, before = _writers.pop(key)
            if depth > 1:
                _writers[key] = (depth - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


def materialise(frame: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    with shuffles_end_with_queries(spark):
        frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete the scratch table behind a frame that materialise() returned and nobody reads again."""
    spark = frame.sparkSession
    for name in {os.path.dirname(f) for f in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
