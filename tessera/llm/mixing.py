"""Operator 6: mix sources to target weights by capped water-filling.

Sources by code point (null last) weigh 5, 2, 1, repeating, and share ``share`` (1.5) times all
sizes. A target stops at ``epochs`` (2) times its source's size; what lies above is shared again by
weight among the others until no target is above its stop. With r = target / source size, each
document is taken floor(r) times whole, and a seeded part of the source once more.

How it runs: the water level is found on one row per source: sources by stop / weight fill up in
that order, so the level is the first at which the sources below it are exactly those that stop
(prefix sums, no loop). For the part, a source's documents are dealt by their seeded hash into
cells of about ``CELL`` documents. Inside a cell, in hash order, the prefix sums of sizes mark
which documents are taken once more: whole ones, and the one at the border for its first words. So
every cell takes its share to the word, no window holds more than a cell, and a hot source is many
cells. The hash is MD5 of seed, doc_id and the text's own MD5, so reruns agree, and rows of one
doc_id or of none lie in as many cells as they have texts; only rows equal in both share a cell.

Defined cases: a null text has size 0; rows with equal doc_id are rows of their own, in order of
size; a null source is a source of its own; a source without words takes nothing; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, numbered, same, table

SHARE, EPOCHS, WEIGHTS, SEED, CELL = 1.5, 2, (5, 2, 1), 7, 1024


def sized(docs: DataFrame, *keep) -> DataFrame:
    """doc_id, source, size (the number of words), digest (of the text) and the columns ``keep`` of every row."""
    size = F.expr(r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)").cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"), *keep)


def targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, documents, source_size and target: one row per source."""
    per = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("*", weight.alias("weight"), (F.col("source_size") * F.lit(epochs)).cast("double").alias("stop"), (F.sum("source_size").over(every) * F.lit(float(share))).alias("total"))
    fills = every.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        ((F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # The level falls behind the first source that it leaves open, so that source has the highest.
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))
    per = per.withColumn("level", F.max(open_level).over(every))
    return per.select("source", "documents", "source_size", F.when(F.col("level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("level") * F.col("weight"))).alias("target"))


def _taken(docs: DataFrame, per_source: DataFrame, seed: int, cell: int, *ties: str) -> DataFrame:
    """Adds to rows with source, doc_id and size: source_size, target and taken. ``ties`` order rows of equal hash and size."""
    per = per_source.withColumnRenamed("source", "_source")
    rows = docs.join(per, same(F.col("source"), F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("digest")))
    cells = F.ceil(F.col("documents") / F.lit(cell))
    rows = rows.select("*", ratio.alias("ratio"), key.alias("key")).withColumn("cell", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), cells))
    part = F.col("ratio") - F.floor("ratio")
    by_cell = Window.partitionBy("source", "cell")
    in_order = by_cell.orderBy("key", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.sum("size").over(in_order).alias("upto"), F.floor(F.sum("size").over(by_cell) * part + F.lit(0.5)).alias("quota"))
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - (F.col("upto") - F.col("size"))))
    return rows.withColumn("taken", (F.floor("ratio") * F.col("size") + once_more).cast("long")).drop("ratio", "key", "cell", "upto", "quota", "documents", "digest")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs``."""
    sizes = cut(sized(docs))
    return _taken(sizes, targets(sizes, share, epochs, weights), seed, cell)


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time perhaps in part.

    Each row follows its own plan, whatever its doc_id. Copies are whole rows of ``docs``; a part keeps the document's first words with the white space
    before each, and n_chars follows it.
    """
    row, own, size, taken, copy, left = (fresh(docs, name) for name in ("_row", "_own", "_size", "_taken", "_copy", "_left"))
    rows = numbered(docs, row)
    sizes = cut(sized(rows, F.col(row).alias("_row")))
    plan = _taken(sizes, targets(sizes), seed, CELL, "_row").where("taken > 0").select(F.col("_row").alias(own), F.col("size").alias(size), F.col("taken").alias(taken))
    rows = rows.join(plan, F.col(row) == F.col(own))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), (F.ceil(F.col(taken) / F.col(size)) - 1).cast("int"))))
    rows = rows.withColumn(left, F.greatest(F.lit(0), F.least(F.col(size), F.col(taken) - F.col(copy) * F.col(size))))
    # The first words that are left: cut behind the last of them.
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col(left).cast("int"))
    whole = F.col(left) == F.col(size)
    out = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(words, "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: doc_id, size, source_size, target and taken of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(text, '')) AS digest
  FROM documents),
per AS (SELECT source, count(*) AS documents, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
         CAST(source_size * 2 AS DOUBLE) AS stop, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
  FROM per),
levels AS (
  SELECT *, (total - coalesce(sum(stop) OVER f, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0::DOUBLE)) AS level
  FROM weighed
  WINDOW f AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (SELECT *, max(CASE WHEN level * weight <= stop THEN level END) OVER () AS water FROM levels),
targets AS (
  SELECT source, documents, source_size, CASE WHEN water IS NULL THEN stop ELSE least(stop, water * weight) END AS target
  FROM leveled),
rows_ AS (
  SELECT s.doc_id, s.source, s.size, t.documents, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS ratio,
         md5('7:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.digest) AS key
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
celled AS (
  SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % CAST(ceil(documents / 1024.0::DOUBLE) AS BIGINT) AS cell FROM rows_),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, cell ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS upto,
         floor(sum(size) OVER (PARTITION BY source, cell) * (ratio - floor(ratio)) + 0.5::DOUBLE) AS quota
  FROM celled)
SELECT doc_id, size, source_size, target,
       CAST(floor(ratio) * size + greatest(0, least(size, quota - (upto - size))) AS BIGINT) AS taken
FROM summed
"""
