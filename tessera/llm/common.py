"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.session import guarded

#: A word, as every contract of this subpackage takes it.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return guarded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session, as in tests, gets a
    temporary folder of its own; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-cut-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders that ``cut`` has written in the innermost ``swept`` of this thread; None outside of one.
_run: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("run", default=None)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Drops at its end what ``cut`` has written inside it; results must be written by then."""
    token = _run.set([])
    try:
        yield
    finally:
        for path in _run.get():
            drop(spark, path)
        _run.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """Write a result as Parquet to the shared folder and read it back.

    Later steps then start from files that outlive any executor, and nothing before is computed
    twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (own := _run.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(df: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``text``, where a null text is the empty text."""
    return df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def same(left, right):
    """Equality that also pairs nulls."""
    return left.eqNullSafe(right)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of each row's own, settled in the shared folder."""
    return cut(docs.withColumn(name, F.monotonically_increasing_id()))
