"""Intermediate tables that survive lost executors."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that a query removes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_writers = 0
_before = ""


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on while any writer is at work; the last one restores what was set."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.set(CLEANUP, _before)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, for tables in between.

    It is below spark.checkpoint.dir; a session of one machine (tests) may leave that unset and gets a
    temporary one, a cluster without it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df, written to shared_folder() and read from there; a job runs at once.

    Later stages survive lost executors, as they read files and need no lineage. The shuffle files that df needed go as soon as
    it is written. The files themselves go with the DataFrame where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, else with the folder.
    """
    spark = df.sparkSession
    shared_folder(spark)
    with _cleaned_up(spark):
        return df.select("*").checkpoint(eager=True)
