"""Readers: JSON lines, JSON documents, TSV, mixed folders, standards as one file each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One row per line; blank lines are skipped, lines that are no JSON land in _corrupt_record if the schema has it."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def json_sections(spark: SparkSession, path: str, schema: T.StructType | str) -> dict[str, DataFrame]:
    """The array sections of one JSON document, each as rows."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return {f.name: whole.select(F.inline(f.name)) for f in whole.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}


def split_records(rows: DataFrame, discriminator: str = "recordType") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a mixed file."""
    return rows.where(F.col(discriminator) == "node"), rows.where(F.col(discriminator) == "edge")


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table with a header; a byte order mark is stripped, missing cells are empty."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="", encoding="UTF-8")
    named = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    return named.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def standards(spark: SparkSession, pattern: str, schema: str, side: DataFrame | None = None, key: str = "standardId") -> DataFrame:
    """One standard per file; a side table may miss some of them."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows if side is None else rows.join(side, key, "left")


def mixed_folder(spark: SparkSession, folder: str) -> DataFrame:
    """CSV, JSON and JSON-lines files of one folder, columns by name, all as text.

    A kind of file that the folder lacks adds nothing.
    """
    kinds = {"csv": lambda r: r.option("header", True).csv(folder), "json": lambda r: r.option("multiLine", True).json(folder), "jsonl": lambda r: r.json(folder)}
    every = None
    for suffix, read in kinds.items():
        pattern = f"*.{suffix}"
        if spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").isEmpty():
            continue
        rows = read(spark.read.option("pathGlobFilter", pattern))
        rows = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns], F.lit(suffix).alias("format"))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    return every if every is not None else spark.createDataFrame([], "format string")


def table_lines(text: DataFrame, column: str = "text") -> DataFrame:
    """code and name of the lines that look like rows of a printed code table."""
    lines = text.select(*[c for c in text.columns if c != column], F.explode(F.split(column, "\n")).alias("line"))
    pattern = r"^\s*(\d{6,8}[A-Z]?)\s+(\S.*?)\s*$"
    return lines.where(F.col("line").rlike(pattern)).withColumns({"code": F.regexp_extract("line", pattern, 1), "name": F.regexp_extract("line", pattern, 2)}).drop("line")


def vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Cached vectors of one model; the model is a partition, so others are not read."""
    return spark.read.parquet(path).where(F.col("model") == model)
