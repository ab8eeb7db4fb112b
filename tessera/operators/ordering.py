"""Numbering all rows of a table in order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.checkpoints import settled


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """Adds the place (from 1) of each row in a total order.

    Rows are sorted by ranges and settled; a row's place is its place in its partition plus the rows
    of the partitions before, of which there is one count each.
    """
    place = settled(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = place.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return place.withColumn("_part", part).join(offsets, "_part").withColumn(name, (F.col("_before") + inside + 1).cast("long")).drop("_m", "_part", "_before")


def within(rows: DataFrame, group: str, order: str, name: str = "at") -> DataFrame:
    """Adds the place (from 1) of each row in its group: its place among all rows less that of the group's first row.

    Unlike a window by group, no task holds a group, however many rows share one. Ties of ``order``
    in a group take places in any order.
    """
    every = numbered(rows, [group, order], "_number")
    first = every.groupBy(group).agg(F.min("_number").alias("_first")).withColumnRenamed(group, "_group")
    return every.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, (F.col("_number") - F.col("_first") + 1).cast("int")).drop("_number", "_first", "_group")
