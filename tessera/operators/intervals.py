"""Joins of intervals by the bins that they touch.

An interval [start, end) is keyed by each bin of ``width`` that it touches, so only intervals of one key and one bin
meet, however many intervals a key has. A pair that shares several bins is kept in its first common one. Empty
intervals meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a bin; a few times the usual length of an interval is best.
WIDTH = 1024


def _binned(rows: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    first = F.floor(start / width)
    return rows.where(start < end).withColumn("_first", first).withColumn("_bin", F.explode(F.sequence("_first", F.floor((end - 1) / width))))


def overlapping(left: DataFrame, right: DataFrame, by: str, ours: tuple[str, str], theirs: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """All pairs of rows of one ``by`` whose intervals overlap; other columns of the two must differ in name."""
    a = _binned(left, F.col(ours[0]), F.col(ours[1]), width).withColumnRenamed("_first", "_a")
    b = _binned(right, F.col(theirs[0]), F.col(theirs[1]), width).withColumnRenamed("_first", "_b")
    met = a.join(b, [by, "_bin"]).where((F.col(ours[0]) < F.col(theirs[1])) & (F.col(theirs[0]) < F.col(ours[1])))
    return met.where(F.col("_bin") == F.greatest("_a", "_b")).drop("_a", "_b", "_bin")


def holding(points: DataFrame, intervals: DataFrame, by: str, point: str, ends: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """All pairs of a point and an interval of one ``by`` that holds it."""
    b = _binned(intervals, F.col(ends[0]), F.col(ends[1]), width).drop("_first")
    a = points.withColumn("_bin", F.floor(F.col(point) / width))
    return a.join(b, [by, "_bin"]).where((F.col(point) >= F.col(ends[0])) & (F.col(point) < F.col(ends[1]))).drop("_bin")
