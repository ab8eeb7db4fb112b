"""Operator 13: Lloyd's clustering by two trees, a cover tree over vectors and one over the centroids of a round.

Vectors are integers, floor(1024 * x). Rows are dealt into blocks of about ``ROWS``, and one task builds the
cover tree of a block once: level by level with half the radius, each row further than the radius from all
centres so far becomes a centre under the one that it was nearest to. A node keeps its centre, the largest
distance of a row below it, and the count and sum of those rows. In each round the centroids
get a tree of their own (halves along the widest dimension, with radii). Pairs of a vector node and a
centroid node are searched from the two roots down, a level of pairs at a time: a pair goes when the
least distance that it allows is above the largest one that the vector node can have to some centroid. A
vector node that one centroid is left for is assigned whole, by its count and sum. Rows in leaves are
compared with the centroids that are left in integers, ties to the smaller number.

Bounds are kept apart by more than the rounding of doubles (``SLACK``), so a pruned centroid is strictly
farther and results are those of the definition: every sum, mean and distance is an integer.

How it runs at scale: the blocks with their trees are written once to the shared folder and read in
each round; a task holds a few blocks and returns count and sum of each cluster, so the shuffle of a round is a
few hundred numbers a task and the driver sees k * (width + 1) numbers. Blocks are bounded, so rows that are
all equal, or a label that a third of the rows have, change nothing.

Defined cases: rows whose vector is null, of another width, or holds a null or non-finite component take no
part; rows of equal id or vector all count; a row without vec_id counts but is no start; fewer rows
than k give fewer clusters; further columns are ignored; an empty table gives an empty result. Distances
that do not fit a long are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.vectors import integers, lists, matrix

K, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
#: Rows in a block, and rows in a leaf of its tree.
ROWS, LEAF = 1024, 8
#: What bounds must differ by, as a share of the distances, to be taken as different.
SLACK = 1e-9


class CoverTree:
    """The cover tree of a block. Node arrays are ordered so that children follow their parent.

    ``first`` and ``last`` say which of the rows in ``order`` lie below a node, ``children`` which nodes hang under it
    (from, to), empty for a leaf. ``centre`` is a row, ``radius`` the largest distance to a row below.
    """

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        n = len(rows)
        x = rows.astype(np.float64)
        square = (x * x).sum(axis=1)

        def away(i: int) -> np.ndarray:
            return np.sqrt(np.maximum(square + square[i] - 2 * (x @ x[i]), 0))

        # Distance to the nearest centre so far, and which one that is; centres of each level, coarse to fine.
        near, owner = away(0), np.zeros(n, np.int64)
        near[0] = 0
        paths, radius = [owner.copy()], near.max()
        floor = 1e-6 * (1 + np.sqrt(square.max(initial=0)))
        while np.bincount(owner, minlength=n).max() > leaf and radius > floor:
            radius /= 2
            while near.max() > radius:
                new = int(near.argmax())
                apart = away(new)
                apart[new] = 0
                # A row goes to a new centre only where it was not covered, so that subtrees stay nested.
                moved = (near > radius) & (apart < near)
                near[moved], owner[moved] = apart[moved], new
            paths.append(owner.copy())
        # Rows in the order of their centres' paths: the rows below a node lie together.
        self.order = np.lexsort(np.array(paths[::-1])) if len(paths) > 1 else np.arange(n)
        own = [p[self.order] for p in paths]
        first, last, centre, children = [0], [n], [0], []
        level = [(0, 0, n)]
        at = 0
        for depth in range(1, len(own) + 1):
            below = []
            for node, a, b in level:
                assert node == at
                at += 1
                if depth == len(own) or b - a <= leaf:
                    children.append((0, 0))
                    continue
                cuts = np.r_[a, a + 1 + np.flatnonzero(np.diff(own[depth][a:b])), b]
                children.append((len(first), len(first) + len(cuts) - 1))
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    below.append((len(first), s, e))
                    first.append(s)
                    last.append(e)
                    centre.append(int(own[depth][s]))
            level = below
        self.first, self.last, self.centre = np.array(first), np.array(last), np.array(centre)
        self.children = np.array(children, np.int64).reshape(-1, 2)
        self.radius = np.array([np.sqrt(((x[self.order[a:b]] - x[c]) ** 2).sum(axis=1).max()) for a, b, c in zip(first, last, centre, strict=True)])


def centroid_tree(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the tree over centroids: middle, radius, the two children (-1 for a leaf), and the number of a leaf's centroid."""
    middle, radius, child, number = [], [], [], []
    x = centroids.astype(np.float64)
    waiting = [np.arange(len(x))]
    made = 1
    while waiting:
        own = waiting.pop(0)
        middle.append(x[own].mean(axis=0) if len(own) > 1 else x[own[0]])
        radius.append(np.sqrt(((x[own] - middle[-1]) ** 2).sum(axis=1).max()))
        if len(own) == 1:
            child.append((-1, -1))
            number.append(int(own[0]))
            continue
        order = own[np.argsort(x[own][:, int(np.argmax(np.ptp(x[own], axis=0)))], kind="stable")]
        waiting += [order[: len(own) // 2], order[len(own) // 2 :]]
        child.append((made, made + 1))
        number.append(-1)
        made += 2
    return np.array(middle), np.array(radius), np.array(child), np.array(number)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, in integers."""
    largest = int(np.abs(rows).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    bound = rows.shape[1] * largest * largest
    if bound >= 2**63:
        raise OverflowError("squared distances do not fit a long")
    kind = np.float64 if 4 * bound < 2**52 else np.int64
    x, c = rows.astype(kind), centroids.astype(kind)
    return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)).astype(np.int64)


def assign(tree: CoverTree, rows: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, int]:
    """Vector nodes that go to one centroid whole (node, centroid), and the others' rows with their centroids; last, how many distances were taken."""
    middle, wide, child, number = centroid_tree(centroids)
    x = rows.astype(np.float64)
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    left: list[tuple[np.ndarray, np.ndarray]] = []
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    taken = 0
    while len(node):
        between = x[tree.centre[node]] - middle[other]
        apart = np.sqrt((between * between).sum(axis=1))
        taken += len(node)
        slack = SLACK * (1 + apart + tree.radius[node] + wide[other])
        low, high = apart - tree.radius[node] - wide[other] - slack, apart + tree.radius[node] + wide[other] + slack
        # The largest distance that a row of the node can have to the nearest centroid.
        reach = np.full(len(tree.first), np.inf)
        np.minimum.at(reach, node, high)
        stays = low <= reach[node]
        node, other = node[stays], other[stays]
        pairs = np.bincount(node, minlength=len(tree.first))
        at_leaf = child[other, 0] < 0
        sole = at_leaf & (pairs[node] == 1)
        whole.append((node[sole], number[other[sole]]))
        rest = ~sole
        node, other, at_leaf = node[rest], other[rest], at_leaf[rest]
        ends = tree.children[node, 1] == tree.children[node, 0]
        # Centroid nodes are opened where the vector node is a leaf or no wider; a vector node, for all of its
        # pairs at once, where none of its centroid nodes is. A leaf with single centroids only is compared row by row.
        by_centroid = ~at_leaf & (ends | (wide[other] >= tree.radius[node]))
        waits = np.zeros(len(tree.first), bool)
        waits[node[by_centroid]] = True
        held = ~by_centroid & waits[node]
        ready = ends & ~waits[node]
        left.append((node[ready], number[other[ready]]))
        by_vector = ~ends & ~waits[node]
        opened = tree.children[node[by_vector]]
        many = opened[:, 1] - opened[:, 0]
        inner = np.repeat(opened[:, 0] - np.r_[0, np.cumsum(many)[:-1]] if len(many) else many, many) + np.arange(many.sum())
        node, other = (
            np.concatenate([np.repeat(node[by_centroid], 2), inner, node[held]]),
            np.concatenate([child[other[by_centroid]].ravel(), np.repeat(other[by_vector], many), other[held]]),
        )
    nodes, to = (np.concatenate(c) for c in zip(*whole, strict=True))
    owed = [(int(n), int(c)) for n, c in zip(nodes, to, strict=True)]
    leaf, option = (np.concatenate(c) for c in zip(*left, strict=True))
    places, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(leaf):
        allowed = np.zeros((len(tree.first), len(centroids)), bool)
        allowed[leaf, option] = True
        for n in np.unique(leaf).tolist():
            places.append(tree.order[tree.first[n] : tree.last[n]])
            best.append(np.full(tree.last[n] - tree.first[n], n))
        place, of = np.concatenate(places), np.concatenate(best)
        distance = np.where(allowed[of], squared(rows[place], centroids), np.iinfo(np.int64).max)
        taken += int(allowed[of].sum())
        return owed, place, distance.argmin(axis=1), taken
    return owed, places[0], best[0], taken


def clusters(tree: CoverTree, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cluster of each row."""
    owed, place, best, _ = assign(tree, rows, centroids)
    out = np.zeros(len(rows), np.int32)
    for node, c in owed:
        out[tree.order[tree.first[node] : tree.last[node]]] = c
    out[place] = best
    return out


_BLOCK = "ids array<long>, rows array<long>, place array<int>, first array<int>, last array<int>, centre array<int>, child array<int>, radius array<double>"
_NAMES = [c.split(" ")[0] for c in _BLOCK.split(", ")]


def _blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """One row for each block: its rows and its tree."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: list, x: np.ndarray) -> pa.RecordBatch:
            tree = CoverTree(x)
            whole = [x.ravel(), tree.order.astype(np.int32), tree.first.astype(np.int32), tree.last.astype(np.int32), tree.centre.astype(np.int32), tree.children.astype(np.int32).ravel(), tree.radius]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(lists(a[None]) for a in whole)], _NAMES)

        ids, held, n = [], [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                ids += part.column("vec_id").to_pylist()
                held.append(matrix(part.column("v"), width))
                n += part.num_rows
                if n >= size:
                    yield block(ids, np.concatenate(held))
                    ids, held, n = [], [], 0
        if n:
            yield block(ids, np.concatenate(held))

    return rows.select("vec_id", "v").mapInArrow(built, _BLOCK)


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray, CoverTree]]:
    for i in range(batch.num_rows):
        ids, rows, order, first, last, centre, child, radius = (batch.column(c)[i].values for c in _NAMES)
        tree = CoverTree.__new__(CoverTree)
        tree.order, tree.first, tree.last, tree.centre = (a.to_numpy().astype(np.int64) for a in (order, first, last, centre))
        tree.children, tree.radius = child.to_numpy().astype(np.int64).reshape(-1, 2), radius.to_numpy()
        yield ids, rows.to_numpy().reshape(-1, width), tree


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            for _, rows, tree in _unpacked(batch, width):
                x = np.c_[np.ones(len(rows), np.int64), rows]
                owed, place, best, _ = assign(tree, rows, centroids)
                # Sums of all rows before each one in tree order: a whole node's sum is a difference.
                upto = np.concatenate([np.zeros((1, width + 1), np.int64), np.cumsum(x[tree.order], axis=0)])
                for node, c in owed:
                    total[c] += upto[tree.last[node]] - upto[tree.first[node]]
                np.add.at(total, best, x[place])
        cluster, dim = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.ravel().astype(np.int32)), pa.array(dim.ravel().astype(np.int32)), pa.array(total.ravel())], ["cluster", "dim", "total"])

    added = blocks.mapInArrow(sums, "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {(r.cluster, r.dim): int(r.total) for r in added.collect()}
    out = centroids.copy()
    for c in range(k):
        if n := totals[c, 0]:
            out[c] = [totals[c, d] // n for d in range(1, width + 1)]
    return out


def fitted(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, size: int = ROWS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray] | None:
    """vec_id, cluster and distance of each vector that takes part, and the centroids after ``rounds`` rounds."""
    rows = integers(vectors, scale).where(F.size("v") == width)
    start = rows.where("vec_id is not null").select("v", F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256).alias("hash")).orderBy("hash", "v").limit(k).toArrow()
    blocks = cut(_blocks(rows, width, size))
    if not len(start):
        return None
    centroids = matrix(start.column("v"), width)
    for _ in range(rounds):
        after = _moved(blocks, centroids)
        if (after == centroids).all():
            break
        centroids = after

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, rows, tree in _unpacked(batch, width):
                own = clusters(tree, rows, centroids)
                distance = ((rows - centroids[own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return cut(blocks.mapInArrow(placed, "vec_id long, cluster int, distance long")), centroids


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the digest of its final centroid for each vector that takes part."""
    spark = vectors.sparkSession
    found = fitted(vectors, **settings)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows, centroids = found
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row for each of k clusters
    digests = {c: hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for c, x in enumerate(centroids)}
    known = spark.createDataFrame([(r.cluster, r.s, sum(x.s for x in per), digests[r.cluster]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: eight clusters of all vectors of 64 components after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle(rounds: int = ROUNDS) -> str:
    """Each round as two tables: the nearest centroid of each vector, and the floor of each component's mean."""
    parts = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {K})"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT n, c, CAST(list_sum(list_transform(list_zip(k.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM kept k CROSS JOIN c{i} x),
a{i} AS MATERIALIZED (SELECT n, c, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, d, sum(x) AS s, count(*) AS m FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i} JOIN kept USING (n)) GROUP BY ALL),
m{i} AS (SELECT c, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY d) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, x.v) AS v FROM c{i} x LEFT JOIN m{i} m USING (c))""")
    parts.append(f"per AS (SELECT c, CAST(sum(distance) AS BIGINT) AS s FROM a{rounds} GROUP BY c)")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM per) AS inertia, sha256(array_to_string(x.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (n) JOIN per USING (c) JOIN c{rounds} x USING (c)"""


ORACLE_SQL = _oracle()
