"""Sinks: ordered JSON lines, batches with a manifest, vectors by model, Markdown pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with the stated fields in their order; nulls are left out."""
    rows.select(*order).write.option("ignoreNullFields", True).mode("overwrite").json(path)


def batches(rows: DataFrame, path: str, size: int) -> DataFrame:
    """Parquet files of at most ``size`` rows, and the manifest of files and rows."""
    rows.write.option("maxRecordsPerFile", size).mode("overwrite").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    return back.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))


def vectors(rows: DataFrame, path: str) -> None:
    """Vectors partitioned by model; only the models written are replaced."""
    rows.write.partitionBy("model").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def front_matter(columns: dict[str, object], body):
    """A page: the columns as front matter, then the body."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit(""))) for name, c in columns.items()]
    plain = [F.regexp_replace(line, r'\{"v":(.*)\}$', "$1") for line in lines]
    return F.concat_ws("\n", F.lit("---"), *plain, F.lit("---"), F.lit(""), body)


def pages(rows: DataFrame, text: str, path: str) -> None:
    """One text per row."""
    rows.select(F.col(text).alias("value")).write.mode("overwrite").text(path)
