"""The folder for intermediate tables that all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go when the session names no folder (a test session on one machine).
LOCAL_BASE = "/tmp/checkpoints/emberlog"


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or LOCAL_BASE where that is unset and the session runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
    return (base or LOCAL_BASE).rstrip("/")


#: Folders that are there now, by the innermost `cleared` that they were made in.
_made: list[list[tuple[SparkSession, str]]] = [[]]


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, deleted at the end of the `cleared` that it is made in, or else when the driver's Python ends."""
    path = f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"
    _made[-1].append((spark, path))
    return path


@contextmanager
def cleared() -> Iterator[None]:
    """Deletes at its end the folders that are made inside it: read or write results before that.

    with cleared():
        detect_bursts(events).write.parquet(...)
    """
    _made.append([])
    try:
        yield
    finally:
        for spark, path in _made.pop():
            _remove(spark, path)


@atexit.register
def _remove_all() -> None:
    for spark, path in (x for own in _made for x in own):
        _remove(spark, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet to a shared path and reads it back: lineage ends here, and a lost executor costs nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
