"""Queries that write files and read them back: JSON lines and sections, tables with headers, printed lists, batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators.checkpoints import folder
from tessera.plans.registry import query
from tessera.sources import readers, sinks
from tessera.sources.domain import table


def _path(spark) -> str:
    return f"{folder(spark)}/files-{uuid.uuid4().hex}"


@query("json_lines_back", "SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS quality, toxic FROM labels")
def json_lines_back(spark, sf):
    """JSON lines with a fixed order of fields and nulls left out, read again."""
    path = _path(spark)
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("quality"), "toxic")
    sinks.json_lines(rows, path, ["toxic", "doc_id", "quality"])
    return readers.json_lines(spark, path, "doc_id long, quality int, toxic int")


@query("json_sections_back", "SELECT 'nation' AS section, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region")
def json_sections_back(spark, sf):
    """The sections of one JSON document as rows."""
    path = _path(spark)
    nations = table(spark, sf, "nation").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("nation"))
    regions = table(spark, sf, "region").agg(F.collect_list(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("region"))
    nations.join(regions).coalesce(1).write.json(path)
    kind = "array<struct<key:int,name:string>>"
    parts = readers.json_sections(spark, path, f"nation {kind}, region {kind}")
    return parts["nation"].select(F.lit("nation").alias("section"), "key", "name").union(parts["region"].select(F.lit("region"), "key", "name"))


@query("tsv_back", "SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS title, CASE WHEN s_nationkey > 5 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS nation FROM supplier")
def tsv_back(spark, sf):
    """A table with a header and missing cells."""
    path = _path(spark)
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("title"), F.when(F.col("s_nationkey") > 5, F.col("s_nationkey")).alias("nation"))
    rows.write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    return readers.tsv(spark, path, ["code", "title", "nation"])


@query("printed_codes", "SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code, p_name AS name FROM part WHERE p_partkey % 3 = 0")
def printed_codes(spark, sf):
    """Codes and names from lines of a printed table, among other lines."""
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("   "), "p_name", F.lit(" "))).otherwise(F.concat(F.lit("see "), "p_name"))
    text = table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return readers.table_lines(text).select("code", "name")


@query("batch_manifest", "SELECT count(*) AS rows_, true AS within_size FROM customer")
def batch_manifest(spark, sf):
    """Files of at most 100 rows, and a manifest that has all rows."""
    manifest = sinks.batches(table(spark, sf, "customer"), _path(spark), 100)
    return manifest.agg(F.sum("rows").alias("rows_"), (F.max("rows") <= 100).alias("within_size"))
