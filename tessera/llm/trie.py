"""Operator 11: the prefix trie of conversations as a Patricia trie that is expanded at the end.

A node is a distinct sequence of first turns (role, text). Nodes lie sorted by the smallest
conversation that has them and by depth: the nodes that one conversation is the smallest holder of are
the last stretch of its path, so a whole path lies together and hangs under one node of another path.
Only *points* get rows of the compressed tree: nodes that branch, nodes where a conversation ends, leaves,
and every ``BLOCK``-th depth, so that no compressed edge is longer than that. Each point carries the sum
of the edge above it. Sums over subtrees come from pointer jumping: in each round a point takes
what the points at twice the last distance below it hold, so there are as many rounds as the logarithm of
the tree's height in points. A unary node then has its point's sums less the part of the edge above itself,
by suffix sums along the edge.

How it runs at scale: texts move once, to be put in order; from there on a turn is 128 bits of hash.
A node's key is the exclusive or of its turns' hashes, each taken with its depth, so keys are running
aggregates over blocks of ``BLOCK`` turns and a conversation that holds a third of all rows is dealt
over many tasks. Members are counted with partial sums before the shuffle, so a first turn that all
conversations share is one row a task. Ends are joined to strings by stretches of ids and hashed in a
stream, so a sequence that a third of the conversations end in needs no more memory than another.
A join on a key with very many rows on one side is left to adaptive skew splitting.

Defined cases: rows without conv_id take no part; a null role or text is empty; a null turn comes first,
ties of turn go by role, then text, and repeated rows are turns of their own; conversations without
turns end at the root; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Turns of a compressed edge, and of a stretch of running keys, at most.
BLOCK = 4096
#: Ids of ends that one string joins span at most so much.
IDS = 4096
#: Conversations of one hundred share the first turns of their first one, up to HEADS - 1 of them.
FAMILY, HEADS = 100, 6
_NODE = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, number (of all turns in order), t1 and t2 (the turn's hash) and chars, written once."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text).where("conv_id is not null")
    # Ranges by conversation and turn, so that one conversation may fill many tasks.
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(name) for seed, name in ((1, "t1"), (2, "t2"))]
    rows = cut(rows.select("conv_id", *hashes, F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33).alias("part")
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    # One row for each task of the sort.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(F.broadcast(offsets), "part").select("conv_id", (F.col("before") + inside).alias("number"), "t1", "t2", "chars")


def plain_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, t1, t2, chars) and conversations (conv_id, turns) as they are."""
    own = ordered_turns(conversations)
    convs = own.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("number").alias("first"))
    turns = own.join(convs, "conv_id").select("conv_id", (F.col("number") - F.col("first") + 1).alias("depth"), "t1", "t2", "chars")
    return turns, convs.select("conv_id", "turns")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``plain_turns``, of conversations whose first turns are those of the first one of their hundred."""
    own = ordered_turns(conversations)
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = convs.select("conv_id", "n", "first", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("base_n"), F.col("first").alias("base_first"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    at = F.col("number") - F.col("first")
    placed = own.join(convs.select("conv_id", "first", "h", "taken"), "conv_id").withColumn("at", at)
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS - 1)).select(F.col("conv_id").alias("base"), "at", "t1", "t2", "chars")
    heads = heads.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("at < taken").select("conv_id", (F.col("at") + 1).alias("depth"), "t1", "t2", "chars")
    tails = placed.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "t1", "t2", "chars")
    return heads.unionByName(tails), convs.select("conv_id", "turns")


def _keyed(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """conv_id, depth, chars, the key of the first ``depth`` turns, the key before it, and whether the conversation ends there."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "t1", "t2").alias(name) for seed, name in ((3, "x1"), (4, "x2"))]
    rows = turns.join(convs, "conv_id").select("conv_id", "depth", "turns", "chars", *hashes, F.floor((F.col("depth") - 1) / block).alias("block"))
    blocks = rows.where(F.col("turns") > block).groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.bit_xor(b).over(earlier).alias(c) for b, c in (("b1", "c1"), ("b2", "c2"))]).where("block > 0")
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({"r1": F.bit_xor("x1").over(upto), "r2": F.bit_xor("x2").over(upto)}).join(carried, ["conv_id", "block"], "left")
    keys = {k: F.col(r).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long"))) for k, r, c in (("k1", "r1", "c1"), ("k2", "r2", "c2"))}
    running = running.withColumns(keys)
    return running.select("conv_id", *_NODE, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "chars", (F.col("depth") == F.col("turns")).alias("ends"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ends, from rows that lie by node and stretch of ids."""
    last, digest = None, None
    for batch in batches:
        done = []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids")), strict=True):
            if node == last:
                digest.update(b",")
            else:
                if digest:
                    done.append((*last, digest.hexdigest()))
                last, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*_NODE, "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, digest.hexdigest())], [*_NODE, "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256 of the nodes that conversations end at; ``rows`` are (conv_id, depth, k1, k2)."""
    stretch = F.floor(F.col("conv_id") / IDS).alias("stretch")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = rows.groupBy(*_NODE, stretch).agg(ids.alias("ids"))
    return strings.repartition(*_NODE).sortWithinPartitions(*_NODE, "stretch").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _subtree_sums(points: DataFrame) -> DataFrame:
    """conv_id, depth, saved and leaves summed over the subtree of each point (conv_id, depth, edge, leaf, up_conv, up_depth)."""
    state = points.select("conv_id", "depth", F.col("edge").alias("saved"), F.col("leaf").alias("leaves"), F.col("up_conv").alias("jump"), F.col("up_depth").alias("jump_depth"))
    while not state.where("jump is not null").isEmpty():
        below = state.where("jump is not null").groupBy(F.col("jump").alias("conv_id"), F.col("jump_depth").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        above = state.where("jump is not null").select(F.col("conv_id").alias("jump"), F.col("depth").alias("jump_depth"), F.col("jump").alias("next"), F.col("jump_depth").alias("next_depth"))
        grown = state.join(below, ["conv_id", "depth"], "left").join(above, ["jump", "jump_depth"], "left")
        state = cut(
            grown.select(
                "conv_id", "depth", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                F.col("next").alias("jump"), F.col("next_depth").alias("jump_depth"),
            )
        )
    return state.select("conv_id", "depth", "saved", "leaves")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes of the prefix trie of ``turns`` (conv_id, depth, t1, t2, chars) of ``convs`` (conv_id, turns).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and point_depth: the depth of the point at the lower end of the node's edge.
    """
    keyed = cut(_keyed(turns, convs, block))
    zero = F.lit(0).cast("long")
    below = keyed.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("chars").alias("chars"), F.count_if("ends").alias("ends")
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("turns") == 0).alias("ends")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"), "ends")
    nodes = cut(below.unionByName(root))
    # A path: the nodes that one conversation is the smallest member of. Its top hangs under a node of another path.
    paths = cut(nodes.groupBy("conv_id").agg(F.min_by(F.struct("depth", "p1", "p2"), "depth").alias("top"), F.max("depth").alias("bottom")))
    tops = paths.where("top.depth > 0").select("conv_id", (F.col("top.depth") - 1).alias("depth"), F.col("top.p1").alias("k1"), F.col("top.p2").alias("k2"))
    holders = nodes.select(*_NODE, F.col("conv_id").alias("parent"))
    hung = cut(tops.join(holders, _NODE).select("conv_id", "parent", F.col("depth").alias("parent_depth")))
    branches = hung.groupBy(F.col("parent").alias("conv_id"), F.col("parent_depth").alias("depth")).agg(F.count("*").alias("others"))
    here = nodes.join(paths.join(hung, "conv_id", "left").select("conv_id", "bottom", "parent", "parent_depth"), "conv_id").join(branches, ["conv_id", "depth"], "left")
    children = (F.col("depth") < F.col("bottom")).cast("long") + F.coalesce("others", F.lit(0))
    # The first node of a path hangs under ``parent``, every other one under the node before; the root under none.
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("parent_depth") + 1, F.col("parent")).otherwise(F.col("conv_id"))
    here = here.select("conv_id", *_NODE, "n_convs", "ends", children.alias("n_children"), parent.alias("parent_conv_id"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saves"))
    point = (F.col("n_children") != 1) | (F.col("ends") > 0) | (F.col("depth") % block == 0)
    stretch = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    here = here.withColumn("stretch", F.floor((F.col("depth") - 1) / block)).withColumn("point_depth", F.min(F.when(point, F.col("depth"))).over(stretch))
    edge = Window.partitionBy("conv_id", "stretch", "point_depth").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    here = cut(here.withColumn("suffix", F.sum("saves").over(edge)).drop("stretch"))
    points = here.groupBy("conv_id", "point_depth").agg(
        F.max("suffix").alias("edge"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min_by(F.struct("parent_conv_id", "depth"), "depth").alias("top")
    )
    points = cut(points.select("conv_id", F.col("point_depth").alias("depth"), "edge", "leaf", F.col("top.parent_conv_id").alias("up_conv"), F.when(F.col("top.parent_conv_id").isNotNull(), F.col("top.depth") - 1).alias("up_depth")))
    sums = _subtree_sums(points).join(points.select("conv_id", "depth", "edge"), ["conv_id", "depth"]).withColumnRenamed("depth", "point_depth")
    at_root = convs.where("turns = 0").select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))
    ends = _ends(keyed.where("ends").select("conv_id", *_NODE).unionByName(at_root))
    expanded = here.join(sums, ["conv_id", "point_depth"]).join(ends, _NODE, "left")
    return expanded.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("edge") + F.col("suffix")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "point_depth",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every node of the trie of the rebuilt conversations."""
    return trie(*rebuilt_turns(table(spark, sf_dir, "conversations"))).drop("point_depth")


#: crc32 by its definition, eight steps a character; nodes by the hash of their turns' list; sums over subtrees
#: by the ancestors of each node on its smallest member's path.
ORACLE_SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, conv_id - conv_id % 100 AS base FROM own),
crc AS (SELECT conv_id, base, s, 0 AS i, 4294967295::BIGINT AS c FROM ids
  UNION ALL SELECT conv_id, base, s, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE c END AS y FROM crc WHERE i < 8 * length(s))),
heads AS (SELECT conv_id, base, xor(c, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(s)),
rebuilt AS (
  SELECT heads.conv_id, 0 AS part, place, role, text FROM heads JOIN own ON own.conv_id = base WHERE place < h
  UNION ALL SELECT conv_id, 1, place, role, text FROM heads JOIN own USING (conv_id) WHERE place >= h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, md5(length(role) || ':' || role || text) AS t, length(text) AS chars FROM rebuilt),
keyed AS (
  SELECT conv_id, depth, chars, md5(string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
lengths AS (SELECT conv_id, max(depth) AS turns FROM keyed GROUP BY conv_id),
nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saves, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = turns), '')) AS ends_sha256
  FROM keyed JOIN lengths USING (conv_id) GROUP BY depth, k),
above AS (SELECT n.depth AS own_depth, n.k AS own_k, n.saves, a.depth, a.k FROM nodes n JOIN keyed a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
children AS (SELECT depth, k, count(*) AS n_children FROM above WHERE depth = own_depth - 1 GROUP BY ALL),
sums AS (
  SELECT a.depth, a.k, CAST(sum(saves) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM above a LEFT JOIN children c ON c.depth = own_depth AND c.k = own_k GROUP BY ALL),
parents AS (SELECT own_depth AS depth, own_k AS k, p.conv_id AS parent_conv_id FROM above a JOIN nodes p ON p.depth = a.depth AND p.k = a.k WHERE a.depth = own_depth - 1)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes JOIN sums USING (depth, k) LEFT JOIN children USING (depth, k) LEFT JOIN parents USING (depth, k)"""
