"""Cutting lineage through the shared folder, and keeping what many queries of a session ask for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-cut-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint into ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(spark))
    return df.checkpoint()


def source_state(spark: SparkSession, sources: list[str]) -> tuple:
    """Time, files and bytes of each source, by which a change is noticed."""
    state = []
    for source in sources:
        place = spark._jvm.org.apache.hadoop.fs.Path(source)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        summary = store.getContentSummary(place)
        state.append((source, store.getFileStatus(place).getModificationTime(), summary.getFileCount(), summary.getLength()))
    return tuple(state)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Kept tables by session, name and sources: the state of the sources and the path.
_KEPT: dict[tuple, tuple[tuple, str]] = {}


def kept(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written when a session first asks for it and read from there afterwards.

    A source that has changed since (its time, files or bytes) makes it anew, and the old table goes.
    """
    key, state = (spark.sparkContext.applicationId, name, *sources), source_state(spark, sources)
    known, path = _KEPT.get(key, (None, None))
    if known != state:
        made = f"{folder(spark)}/kept-{name}-{uuid.uuid4().hex}"
        make().write.parquet(made)
        if path:
            drop(spark, path)
        _KEPT[key] = state, (path := made)
    return spark.read.parquet(path)
