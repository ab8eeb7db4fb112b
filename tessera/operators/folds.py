"""Sequential folds that no window expresses, one bounded group at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reset_pack(rows: DataFrame, group: str, order: str, size: Column, target: int) -> DataFrame:
    """Adds parent: rows of a group, in order, gathered until their sizes reach ``target``.

    A fold over an array of one group's (order, size) pairs finds the rows that end a parent; texts
    stay out of it, and the array it makes has an item for each parent.
    """
    sized = rows.withColumn("_size", size.cast("long"))
    lists = sized.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col("_size").alias("n")))).alias("l"))
    fold = (
        "aggregate(l, named_struct('sum', 0L, 'out', cast(array() as array<bigint>)), (a, x) -> "
        f"if(a.sum + x.n >= {target}, named_struct('sum', 0L, 'out', array_append(a.out, x.o)), named_struct('sum', a.sum + x.n, 'out', a.out)), a -> a.out)"
    )
    ends = lists.select(F.col(group).alias("_group"), F.explode(F.expr(fold)).alias("_end"), F.lit(1).alias("_ends"))
    marked = sized.drop("_size").join(ends, (F.col(group) == F.col("_group")) & (F.col(order) == F.col("_end")), "left")
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("parent", F.coalesce(F.sum("_ends").over(before), F.lit(0)).cast("int")).drop("_group", "_end", "_ends")


def greedy_quota(rows: DataFrame, group: str, by: str, key: str, section: str, quota: int, cap: int) -> DataFrame:
    """``quota`` rows of each group by falling ``by``, at most ``cap`` of a section, with their place.

    Only a section's ``cap`` best rows can be picked, and of those the ``quota`` best are what going
    through all rows one by one would pick.
    """
    best = Window.partitionBy(group, section).orderBy(F.desc(by), key)
    few = rows.select(group, section, key, by).withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= cap).drop("_nth")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), key))
    return few.withColumn("place", place).where(F.col("place") <= quota)
