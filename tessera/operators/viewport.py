"""What of a laid-out graph a view shows: the camera that fits a set of nodes, and edges cut at boxes.

All are expressions over one row, so edges of any number are cut where they lie. What several of them need is worked
out once a row, by ``once``: a filter that Spark moves down takes all that it is made of along, at each place again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def camera(nodes: DataFrame, width: float, height: float, pad: float) -> DataFrame:
    """One row: the middle of the nodes' box (x, y) and the scale (1 at most) at which it fits ``width`` by ``height`` with ``pad`` around."""
    box = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 is not null")
    scale = F.least(F.lit(1.0), F.lit(float(width)) / (F.col("x1") - F.col("x0") + 2 * pad), F.lit(float(height)) / (F.col("y1") - F.col("y0") + 2 * pad))
    return box.select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), scale.alias("scale"))


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that are worked out once a row, whatever is filtered by them or made of them; a list of one struct, laid out, is one row."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def trimmed(edges: DataFrame, half_width: float, half_height: float) -> DataFrame:
    """Edges (x0, y0, x1, y1 between the middles of two nodes) that end at the border of each node's box, or in its middle where the boxes meet it before."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def reach(d: Column, half: float) -> Column:
        return F.when(d == 0, F.lit(float("inf"))).otherwise(half / F.abs(d))

    t = F.least(F.lit(1.0), reach(dx, half_width), reach(dy, half_height))
    edges, t = once(edges, _t=F.when((dx == 0) & (dy == 0), 0.0).otherwise(t)), F.col("_t")
    return edges.withColumns({"x0": F.col("x0") + dx * t, "y0": F.col("y0") + dy * t, "x1": F.col("x1") - dx * t, "y1": F.col("y1") - dy * t}).drop("_t")


def clipped(edges: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """The parts of edges (x0, y0, x1, y1) inside a rectangle; edges that pass it by are left out."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sides = [(-dx, F.col("x0") - left), (dx, right - F.col("x0")), (-dy, F.col("y0") - top), (dy, bottom - F.col("y0"))]
    # An edge enters at sides that it comes towards and leaves at those that it goes towards.
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p).otherwise(0.0) for p, q in sides])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, q / p).otherwise(1.0) for p, q in sides])
    beside = F.lit(False)
    for p, q in sides:
        beside = beside | ((p == 0) & (q < 0))
    inside = once(edges, _in=enter, _out=leave, _beside=beside).where(~F.col("_beside") & (F.col("_in") <= F.col("_out")))
    ends = {"x0": F.col("x0") + dx * F.col("_in"), "y0": F.col("y0") + dy * F.col("_in"), "x1": F.col("x0") + dx * F.col("_out"), "y1": F.col("y0") + dy * F.col("_out")}
    return inside.withColumns(ends).drop("_in", "_out", "_beside")
