"""Greedy picks without reuse, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoints import settled


def without_reuse(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Of pairs (a, b), those that a greedy pick in ``order`` takes when no a or b may be used twice.

    A pair that comes first for both of its ends is one that the greedy pick takes; taking all such
    pairs and dropping what they use, round by round, gives the same pairs as going through them one
    by one.
    """
    left, taken = settled(pairs), None
    while not left.isEmpty():
        at = F.struct(*order, "a", "b")
        ends = left.select(F.col("a").alias("end"), at.alias("at")).union(left.select("b", at))
        first = ends.groupBy("end").agg(F.min("at").alias("best"))
        marked = left.withColumn("at", at)
        both = marked.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").where("at = x and at = y")
        now = settled(both.select(*pairs.columns))
        taken = now if taken is None else taken.union(now)
        used = now.select(F.col("a").alias("end")).union(now.select("b"))
        left = settled(left.join(used, F.col("a") == F.col("end"), "left_anti").join(used, F.col("b") == F.col("end"), "left_anti"))
    return pairs if taken is None else taken
