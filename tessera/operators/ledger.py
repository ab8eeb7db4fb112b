"""Append-only ledgers: latest state, idempotent appends, state machines, paging and fingerprints.

All take a DataFrame of events; state is an aggregation or a window per key, so reruns over the same
events give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last event; partial aggregates keep a busy key small."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_s")
    return events.groupBy(*keys).agg(best, F.count("*").alias("versions")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in columns], "versions")


def first_only(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first event of each key: appends that repeat a key are ignored."""
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("_s")
    return events.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in columns])


def confirmed_state(events: DataFrame, key: str, order: list[str], action: str, value: str) -> DataFrame:
    """key, status and value: a candidate may be replaced until it is confirmed; later candidates then change nothing.

    The first confirmation takes the value of the last candidate before it. Both are aggregates.
    """
    at = F.struct(*order)
    first = events.where(F.col(action) == "confirm").groupBy(key).agg(F.min(at).alias("_confirmed"))
    joined = events.where(F.col(action) == "candidate").join(first, key, "left")
    before = F.when(F.col("_confirmed").isNull() | (at < F.col("_confirmed")), F.struct(at.alias("o"), F.col(value).alias("v")))
    state = joined.groupBy(key).agg(F.max(before).alias("_s"), F.first("_confirmed").alias("_c")).where("_s is not null")
    return state.select(key, F.when(F.col("_c").isNull(), "candidate").otherwise("confirmed").alias("status"), F.col("_s.v").alias(value))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in order, with the total and whether more follow; a top-k, not a global sort."""
    total = rows.count()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(offset + limit < total)})


def fingerprint(rows: DataFrame, key: str, item: Column) -> DataFrame:
    """key, n and the SHA-1 of the key's sorted items."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sha1(F.array_join(F.array_sort(F.collect_set(item)), "\n")).alias("fingerprint"))


def changed(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the key's previous one."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_v", value).withColumn("_before", F.lag("_v").over(w)).where(F.col("_before").isNull() | (F.col("_v") != F.col("_before"))).drop("_v", "_before")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Session windows per key with their number of events."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each row of ``left`` with the last ``value`` of ``right`` at or before its time, of the same key.

    Both sides are one sorted window, so there is no join that multiplies rows.
    """
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    other = right.select(F.col(key), F.col(time), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(other, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_side", "_v")


def session_states(events: DataFrame, gap: str) -> DataFrame:
    """key, start, end, requests, status and value of each session of ``events`` (key, request, at, action, value).

    A request counts once, at its earliest time; a session ends when ``gap`` passes without one; in it the last
    candidate before the first confirmation stays.
    """
    once = events.groupBy("key", "request").agg(F.min_by(F.struct("at", "action", "value"), "at").alias("e")).select("key", "request", "e.*")
    order = Window.partitionBy("key").orderBy("at", "request")
    opens = (F.col("at") - F.lag("at").over(order) < F.expr(f"interval {gap}")).cast("int")
    cut = once.withColumn("_new", 1 - F.coalesce(opens, F.lit(0)))
    cut = cut.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("at", "request")
    confirmed = F.min(F.when(F.col("action") == "confirm", place)).over(Window.partitionBy("key", "_session"))
    cut = cut.withColumn("_confirmed", confirmed).withColumn("_place", place)
    before = (F.col("action") == "candidate") & (F.col("_confirmed").isNull() | (F.col("_place") < F.col("_confirmed")))
    return cut.groupBy("key", "_session").agg(
        F.min("at").alias("start"), (F.max("at") + F.expr(f"interval {gap}")).alias("end"), F.count("*").alias("requests"),
        F.when(F.count("_confirmed") > 0, "confirmed").otherwise("candidate").alias("status"), F.max_by(F.when(before, F.col("value")), F.when(before, F.col("_place"))).alias("value"),
    ).drop("_session")
