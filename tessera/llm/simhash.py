"""Operator 10: SimHash near-duplicates, found in BK-trees.

Fingerprints are 64-bit majority votes over the XXH64 hashes of three-word shingles. Two
fingerprints link when at most ``radius`` (3) bits differ, and documents whose fingerprints hang
together form one component.

How it runs: equal fingerprints are grouped first, so exact copies cost one row. The 64 bits are
cut into six stretches; two fingerprints that differ in at most three bits agree in three stretches
at least, so each distinct fingerprint is routed to 20 shards, one for the bits of each choice of
three (about 32 bits), and every link lies inside a shard. Fingerprints that only happen to share a
shard are as many as pairs there are over 2^32, not over 2^16 as with four bands. In a shard,
a BK-tree (children keyed by their integer Hamming distance to the parent) is searched along the
edges within the radius only. A shard tree travels to the fingerprints that can match it; sending
every tree to every executor would grow with the corpus. Shards above ``SHARD`` fingerprints are
cut into blocks, and each pair of blocks is a group of its own: the first one's tree, searched by
the second. A group returns only a spanning forest of its links, and components come from label
propagation with pointer jumping.

Defined cases: a null text is the empty text; a text without words has the fingerprint zero and
links like any other; repeated rows and rows that share a ``doc_id`` are separate rows of one
component; a null ``doc_id`` never names a component unless all of its members are null; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, numbered, table, text_or_empty

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints in one shard tree at most.
SHARD = 20_000
#: Ends of the stretches of bits: of six, three at least are equal where three bits differ.
STRETCHES = (0, 11, 22, 33, 44, 54, 64)
#: Below this many fingerprints a subtree is a plain list.
LEAF = 24
_BITS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - SHINGLE + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        part = hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(_BITS[ones * 2 > n].sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter(map(fingerprint, batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    docs = text_or_empty(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return docs.mapInArrow(_fingerprints, "doc_id long, fp long")


def bk_tree(values: np.ndarray, at: np.ndarray):
    """A BK-tree over ``values[at]``: a leaf is an array, a node (its index, {distance: child})."""
    if len(at) <= LEAF:
        return at
    root, rest = at[0], at[1:]
    apart = np.bitwise_count(values[rest] ^ values[root])
    order = np.argsort(apart, kind="stable")
    keys, starts = np.unique(apart[order], return_index=True)
    return root, {int(k): bk_tree(values, part) for k, part in zip(keys, np.split(rest[order], starts[1:]), strict=True)}


def bk_search(tree, values: np.ndarray, queries: np.ndarray, at: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index of a query, index of a value) at most ``radius`` apart."""
    stack = [(tree, at)]
    while stack:
        node, at = stack.pop()
        if isinstance(node, np.ndarray):
            apart = np.bitwise_count(queries[at][:, None] ^ values[node][None, :])
            q, v = np.nonzero(apart <= radius)
            yield at[q], node[v]
            continue
        root, children = node
        apart = np.bitwise_count(queries[at] ^ values[root]).astype(np.int16)
        near = at[apart <= radius]
        if len(near):
            yield near, np.full(len(near), root)
        for key, child in children.items():
            down = at[np.abs(apart - key) <= radius]
            if len(down):
                stack.append((child, down))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``n`` items is linked to."""
    label = np.arange(n)

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                return
            low = np.minimum(la, lb)
            np.minimum.at(label, la, low)
            np.minimum.at(label, lb, low)
            while (label[label] != label).any():
                label[:] = label[label]

    held, size = [], 0
    for a, b in pairs:
        if len(a):
            held.append((a, b))
            size += len(a)
        if size > 500_000:
            settle(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            held, size = [], 0
    if held:
        settle(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
    return label


def masks(radius: int = RADIUS) -> list[int]:
    """Masks, as signed longs, of all choices of the stretches that ``radius`` different bits leave equal."""
    bits = [sum(1 << i for i in range(low, high)) for low, high in zip(STRETCHES, STRETCHES[1:], strict=False)]
    found = [sum(x) for x in combinations(bits, len(bits) - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _group_links(fp: np.ndarray, in_tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spanning links of one group: the values under ``in_tree`` form the tree, the others search it, or all where there are no others."""
    tree = np.flatnonzero(in_tree)
    asking = np.arange(len(fp)) if len(tree) == len(fp) else np.flatnonzero(~in_tree)
    label = spanning(len(fp), bk_search(bk_tree(fp, tree), fp, fp, asking))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the last group of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []

    def bounds(key: np.ndarray) -> np.ndarray:
        return np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)]

    def keys(rows) -> np.ndarray:
        return np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("shard", "first", "second")], axis=1)

    def done(rows: pa.Table) -> pa.RecordBatch:
        fp, in_tree, at = rows.column("fp").to_numpy().view(np.uint64), rows.column("tree").to_numpy(), bounds(keys(rows))
        found = [_group_links(fp[at[i] : at[i + 1]], in_tree[at[i] : at[i + 1]]) for i in np.flatnonzero(np.diff(at) > 1)]
        ends = [np.concatenate([x[side] for x in found] or [fp[:0]]).view(np.int64) for side in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = keys(batch)
        if held and (keys(held[-1])[-1] != key[0]).any():
            yield done(pa.Table.from_batches(held))
            held = []
        last = int(bounds(key)[-2])
        if last:
            yield done(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield done(pa.Table.from_batches(held))


def links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that span all links."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks())])
    routed = distinct.select("fp", F.explode(keys).alias("shard"))
    several = routed.groupBy("shard").count().where("count > 1").select("shard", F.ceil(F.col("count") / shard).cast("int").alias("blocks"))
    routed = routed.join(several, "shard").select("fp", "shard", "blocks", F.pmod(F.xxhash64("fp", F.lit("block")), "blocks").cast("int").alias("own"))
    # A fingerprint meets each block of its shard, in the tree where its own block is the first of the two.
    groups = routed.select("fp", "shard", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    groups = groups.select("fp", "shard", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") <= F.col("other")).alias("tree"))
    return groups.repartition("shard", "first", "second").sortWithinPartitions("shard", "first", "second").mapInArrow(_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, for each node of ``edges`` (a, b)."""
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        offered = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, "u").select("u", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        stepped = cut(lower.join(jump, "label").select("u", "old", F.least("label", "next").alias("label")))
        labels = stepped.select("u", "label")
        if not stepped.where("old <> label").head(1):
            return labels


def near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    own = cut(fingerprints(docs))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(distinct, shard))
    rooted = distinct.join(labels.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the one of smallest doc_id, null last; of equal ones, the first row."""
    row = fresh(docs, "_row")
    rows = numbered(docs, row)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("_own"), "component_id")
    found = found.join(rows.select(F.col(row).alias("_row"), "doc_id"), F.col("_own") == F.col("_row"))
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")).select(F.col("first._row").alias("_kept"))
    return rows.join(kept.toDF(f"{row}_kept"), F.col(row) == F.col(f"{row}_kept"), "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: doc_id, fingerprint (16 hex digits) and component_id of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
