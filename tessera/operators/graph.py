"""Graph operators over edges (src, dst): neighbourhoods, closure, depth, cycles.

Iterations are joins of the frontier with the edges; each round's result is checkpointed to the
shared folder, so a lost executor costs one round and plans stay short. Reached pairs are an
aggregation by key, never a driver-side set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoints import settled

#: Rounds after which what was found so far is settled, so plans stay short.
SHORTEN = 16
#: Tasks that may share the neighbours of one node.
SHARES = 8


def _both_ways(edges: DataFrame) -> DataFrame:
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.inline(F.array(F.struct("src", "dst"), back)))


def _inner(edges: DataFrame, reference: str) -> DataFrame:
    return edges.where(~F.startswith("dst", F.lit(reference)) & ~F.startswith("src", F.lit(reference))).select("src", "dst")


def _known(rows: DataFrame, end: str, nodes: DataFrame, tasks: int | None) -> DataFrame:
    """The rows whose ``end`` is a node; a task holds its share of the nodes, never all of them, and rows pass by unsorted.

    An inner join with each node once, as Spark takes a semi join down to where the rows are read, before equal ones are one.
    """
    known = nodes.select(F.col("node").alias("_node")).distinct().hint("shuffle_hash")
    return (rows.repartition(tasks, end) if tasks else rows).join(known, F.col(end) == F.col("_node")).drop("_node")


def undirected(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """src and dst of both directions of each edge, once; ``tasks`` many take the edges, or as many as the session makes."""
    both = _both_ways(edges)
    return (both.repartition(2 * tasks, "src", "dst") if tasks else both).distinct()


def adjacency(edges: DataFrame, nodes: DataFrame, reference: str = "chunk:", tasks: int | None = None) -> DataFrame:
    """src and dst of both directions of each edge between two known nodes; ends that begin with ``reference`` are evidence, not nodes."""
    inner = _inner(edges, reference)
    for end in ("src", "dst"):
        inner = _known(inner, end, nodes, tasks)
    return undirected(inner, tasks)


def neighbours(edges: DataFrame, nodes: DataFrame, tasks: int, reference: str = "chunk:") -> DataFrame:
    """node, neighbours (how many) and first (the smallest) of each node in ``adjacency``.

    ``tasks`` many take the edges. The neighbours of a node are dealt in shares, so no task holds all of those
    of a node that has very many; each share is made distinct and counted where it lies.
    """
    share = F.pmod(F.xxhash64("dst"), F.lit(SHARES)).alias("share")
    both = _known(_both_ways(_inner(edges, reference)), "dst", nodes, 2 * tasks)
    shares = both.select("src", "dst", share).repartition(2 * tasks, "src", "share").distinct().groupBy("src", "share").agg(F.count("*").alias("n"), F.min("dst").alias("first"))
    # Ends of edges that are no nodes themselves go at last, when there is a row of each.
    found = shares.repartition(tasks, "src").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("neighbours"), F.min("first").alias("first"))
    return _known(found, "node", nodes, None)


def hops(edges: DataFrame, seeds: DataFrame, k: int, directed: bool = False) -> DataFrame:
    """seed, node and hop: distance of every node within k steps of each seed (column ``seed``)."""
    steps = edges.select("src", "dst").distinct() if directed else undirected(edges)
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, k + 1):
        found = frontier.join(steps, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = settled(found.join(reached, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def closure(edges: DataFrame) -> DataFrame:
    """src, dst and depth (the longest way) of every reachable pair of an acyclic graph, however long its ways.

    A way that comes back to where it began is an error, as ways then have no longest one.
    """
    paths = settled(edges.select("src", "dst").distinct())
    level, found, length = paths, None, 1
    while not level.isEmpty():
        if not level.where("src = dst").isEmpty():
            raise ValueError("the edges have a cycle")
        own = level.withColumn("depth", F.lit(length))
        found = own if found is None else found.union(own)
        if length % SHORTEN == 0:
            found = settled(found.groupBy("src", "dst").agg(F.max("depth").alias("depth")))
        level = settled(level.join(paths.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct())
        length += 1
    found = paths.withColumn("depth", F.lit(0)) if found is None else found
    return found.groupBy("src", "dst").agg(F.max("depth").alias("depth"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and depth: the longest way from a node without parents; 0 there.

    Rounds keep the nodes that a way of so many steps reaches. Each is among those of the round
    before, so a round that loses none would go on for ever: an error.
    """
    steps = settled(edges.select("src", "dst").distinct())
    reached = settled(steps.select(F.col("dst").alias("node")).distinct())
    found, length, n = None, 1, reached.count()
    while n:
        own = reached.withColumn("depth", F.lit(length))
        found = own if found is None else found.union(own)
        if length % SHORTEN == 0:
            found = settled(found.groupBy("node").agg(F.max("depth").alias("depth")))
        reached = settled(steps.join(reached, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct())
        left = reached.count()
        if left == n:
            raise ValueError("the edges have a cycle")
        length, n = length + 1, left
    own = nodes.select("node").distinct()
    if found is None:
        return own.withColumn("depth", F.lit(0))
    return own.join(found.groupBy("node").agg(F.max("depth").alias("depth")), "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def ancestors(held: DataFrame, edges: DataFrame) -> DataFrame:
    """``held`` (owner, node) and every node from which edges lead to one of an owner's; only what owners hold is walked up from."""
    steps = settled(edges.select("src", "dst").distinct())
    reached = frontier = settled(held.select("owner", "node").distinct())
    rounds = 0
    while not frontier.isEmpty():
        found = frontier.join(steps, F.col("node") == F.col("dst")).select("owner", F.col("src").alias("node")).distinct()
        frontier = settled(found.join(reached, ["owner", "node"], "left_anti"))
        reached, rounds = reached.union(frontier), rounds + 1
        if rounds % SHORTEN == 0:
            reached = settled(reached)
    return reached


def relaxed(values: DataFrame, edges: DataFrame, least: bool = False) -> DataFrame:
    """node and value: the largest (or ``least``) value of a node and of all from which edges lead to it.

    A fixpoint over frontiers: a round sends on only what the last one has raised, so it also ends on cycles
    and there is no closure. ``values`` has node and value for every node.
    """
    steps = settled(edges.select("src", "dst").distinct())
    best = F.min if least else F.max
    state = frontier = settled(values.select("node", "value"))
    while True:
        sent = frontier.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(best("value").alias("sent"))
        better = F.col("sent") < F.col("value") if least else F.col("sent") > F.col("value")
        frontier = settled(sent.join(state, "node").where(better).select("node", F.col("sent").alias("value")))
        if frontier.isEmpty():
            return state
        raised = frontier.withColumnRenamed("value", "raised")
        state = settled(state.join(raised, "node", "left").select("node", F.coalesce("raised", "value").alias("value")))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and component: the strongly connected component of each node, named by its smallest node.

    Colouring forward and backward: nodes without a way in or out are peeled off as components of their
    own; each other node takes the smallest node that reaches it as its colour, and those of a colour
    that reach that node back are a component, which goes. All components of a round are found together.
    """
    left = settled(edges.select("src", "dst").where("src <> dst").distinct())
    every = left.select(F.col("src").alias("node")).union(left.select("dst"))
    every = settled((every if nodes is None else every.union(nodes.select("node"))).distinct())
    found = None
    while True:
        n = -1
        while (m := left.count()) != n:
            n = m
            inner = left.select("src").intersect(left.select("dst")).withColumnRenamed("src", "node")
            left = settled(left.join(inner, F.col("src") == F.col("node"), "left_semi").join(inner, F.col("dst") == F.col("node"), "left_semi"))
        if not m:
            break
        own = left.select(F.col("src").alias("node")).distinct()
        colour = settled(relaxed(own.withColumn("value", F.col("node")), left, least=True).withColumnRenamed("value", "colour"))
        a, b = (colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst"))
        inside = settled(left.join(a, "src").join(b, "dst").where("src_colour = dst_colour").select("src", "dst"))
        # Back from the smallest node of a colour, which reaches all of its colour.
        roots = colour.where("node = colour").select("node", F.lit(1).alias("value"))
        others = colour.where("node <> colour").select("node", F.lit(0).alias("value"))
        back = relaxed(roots.unionByName(others), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        done = settled(back.where("value = 1").join(colour, "node").select("node", F.col("colour").alias("component")))
        found = done if found is None else found.union(done)
        for end in ("src", "dst"):
            left = left.join(done, F.col(end) == F.col("node"), "left_anti")
        left = settled(left)
    if found is None:
        return every.withColumn("component", F.col("node"))
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """src and dst of the acyclic graph of components (node, component)."""
    a, b = (components.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")) for end in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def peeled(edges: DataFrame) -> DataFrame:
    """node: those left when nodes without a way in or out are taken off again and again: on cycles, or on a way from one to another.

    A few cheap rounds, which tell whether there is a cycle; ``cyclic`` takes components to leave out the ways between.
    """
    left = settled(edges.select("src", "dst").distinct())
    n = left.count()
    while True:
        inner = left.select("src").intersect(left.select("dst")).withColumnRenamed("src", "node")
        left = settled(left.join(inner, F.col("src") == F.col("node"), "left_semi").join(inner, F.col("dst") == F.col("node"), "left_semi"))
        if (m := left.count()) == n:
            return left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        n = m


def cyclic(edges: DataFrame) -> DataFrame:
    """node: those that lie on a cycle, loops included."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    several = components(edges)
    many = several.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return several.join(many, "component", "left_semi").select("node").union(loops).distinct()


def witness(edges: DataFrame) -> DataFrame:
    """step (from 0) and node of a shortest cycle through the smallest node that lies on one; empty where there is none.

    Of several the one whose nodes, taken from its end, are smallest.
    """
    steps = settled(edges.select("src", "dst").distinct())
    first = cyclic(steps).agg(F.min("node").alias("node")).where("node is not null")
    levels = [settled(first)]
    spark, reached = edges.sparkSession, levels[0].limit(0)
    if levels[0].isEmpty():
        return levels[0].select(F.lit(0).alias("step"), "node")
    start = levels[0].first().node
    while levels[-1].where(F.col("node") == F.lit(start)).isEmpty() or len(levels) == 1:
        ahead = levels[-1].join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        levels.append(settled(ahead.join(reached, "node", "left_anti")))
        reached = settled(reached.union(levels[-1]))
    # One node a step: a path of as many rows as the cycle is long.
    at, path = start, []
    for level in levels[-2::-1]:
        at = level.join(steps.where(F.col("dst") == F.lit(at)), F.col("node") == F.col("src"), "left_semi").agg(F.min("node")).first()[0]
        path.append(at)
    schema = levels[0].select(F.lit(0).alias("step"), "node").schema
    return spark.createDataFrame(list(enumerate(path[::-1])), schema)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst and missing (the end that no node has)."""
    ids = nodes.select("node").distinct()
    gone = [edges.join(ids, F.col(c) == F.col("node"), "left_anti").select("src", "dst", F.lit(c).alias("missing")) for c in ("src", "dst")]
    return gone[0].union(gone[1])


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree_in and degree_out."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("degree_in"), F.sum("o").alias("degree_out"))
