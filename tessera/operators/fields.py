"""Sections of texts by their titles, and fields read from them with the places that prove them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalised

#: Characters that a title line may have more than the title that it begins with.
MORE = 8


def sections(docs: DataFrame, titles: dict[str, list[str]], first: str = "header") -> DataFrame:
    """doc_id, section, lines and text of each section of ``text``: a title line opens one, and what stands before the first is ``first``.

    A line is a title when, normalised, it is one of ``titles`` (section: titles in lower case) or begins with one and is
    ``MORE`` characters longer at most. What follows a colon in a title line belongs to the section. Lines of a
    section that opens several times are joined in order.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    plain, name = normalised(F.regexp_replace("line", r"[:：].*$", "")), F.lit(None).cast("string")
    for section, own in reversed(titles.items()):
        hit = F.lit(False)
        for title in own:
            hit = hit | (F.startswith(plain, F.lit(title)) & (F.length(plain) <= len(title) + MORE))
        name = F.when(hit, section).otherwise(name)
    lines = lines.withColumn("title", name)
    upto = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.trim(F.regexp_extract("line", r"[:：](.*)$", 1))
    placed = lines.withColumns({"section": F.coalesce(F.last("title", ignorenulls=True).over(upto), F.lit(first)), "kept": F.when(F.col("title").isNull(), F.col("line")).when(rest != "", rest)})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("at", "kept")))), lambda x: x.kept), "\n")
    return placed.groupBy("doc_id", "section").agg(F.count("kept").alias("lines"), text.alias("text"))


def extracted(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, field, value, start and end of the first match of each pattern (field: regular expression) in ``text``; texts without one have no row.

    ``start`` and ``end`` are places in the whole text (from 0, end exclusive), where the value first stands.
    """
    found = F.array(*[F.struct(F.lit(field).alias("field"), F.regexp_extract("text", pattern, 0).alias("value")) for field, pattern in patterns.items()])
    rows = docs.select("doc_id", "text", F.explode(found).alias("f")).where("f.value <> ''")
    start = (_place(F.col("text"), F.col("f.value")) - 1).cast("long")
    return rows.select("doc_id", "f.field", "f.value", start.alias("start"), (start + F.length("f.value")).alias("end"))


def _place(text: Column, part: Column) -> Column:
    return F.call_function("instr", text, part)
