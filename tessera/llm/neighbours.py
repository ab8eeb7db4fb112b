"""Operator 3: approximate nearest neighbours by stable projections and kd-trees with a chi-square stop.

Vectors are projected to ``DIMS`` (16) dimensions by Gaussian (2-stable) directions. The squared
distance of two projections is the squared distance of the vectors times a chi-square variable of
``DIMS`` degrees, so a search that visits projected neighbours by rising projected distance r may
stop when r^2 / d^2 passes the ``CONFIDENCE`` (0.92) quantile, d being the distance of the k-th best
verified vector: any better vector would have been met with that probability, so the expected recall
is that probability at least. Inner products become distances by one more coordinate:
sqrt(M^2 - |x|^2) for rows, 0 for queries scaled to M, the largest norm.

How it runs: equal vectors are one point with their k + 1 smallest ids (a larger id cannot reach a
list of k), found in two salted steps, so a vector that a third of the rows share is one row. A
kd-tree cuts the space into cells of about ``CELL`` points: its first ``TOP`` levels are fitted on
``SAMPLE`` points, the next ones in tasks, on about as many points of each cell of the first levels;
every point is indexed in its cell, and a cell that came out larger is dealt into blocks. The first levels' nodes
have the tight boxes of their points in all dimensions, which the lower cells' splits cut further.
A query first searches its own block, then the ``NEAR`` nearest cells that the distance found so far and the
chi-square bound leave, then those that the nearer bound still leaves; the queries of one block are dealt to groups of about ``ASKED``. In a
block, leaves of a kd-tree are visited by rising projected distance until the test holds for the
leaf, and of a leaf those points are verified in double precision for which it does not hold.
``Search.share`` reports which part of all pairs that was, and
``Search.sent`` how many copies of queries went to other blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without vec_id; rows equal in id and vector count once; shorter vectors count as
padded with zeros; fewer candidates than k give shorter lists; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

K, EVERY, DIMS, CONFIDENCE, SEED = 20, 20, 16, 0.92, 5
#: Points that a part of the tree is fitted on, points in one cell, levels of each of the tree's two parts at most, points in one leaf.
SAMPLE, CELL, TOP, LEAF = 8192, 8192, 10, 32
#: Queries that one group of a block holds.
ASKED = 4096
#: Nearest cells that a query visits before its k-th best score is taken anew.
NEAR = 4
#: Queries searched together.
TOGETHER = 128


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """Quantile of a chi-square variable with an even number of degrees, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= x / 2 / (i + 1)
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return high


def directions(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(width + 1, DIMS))


def split(points: np.ndarray, at: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Leaves of a kd-tree: halves along the widest dimension."""
    stack = [at]
    while stack:
        at = stack.pop()
        if len(at) <= leaf:
            yield at
            continue
        own = points[at]
        order = np.argpartition(own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))], len(at) // 2)
        stack += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


def fitted(points: np.ndarray, levels: int) -> np.ndarray:
    """Splits (dimension, value) of a kd-tree by node: the root is 1, the children of i are 2i and 2i + 1."""
    splits = np.zeros((2**levels, 2))
    held = {1: points}
    for node in range(1, 2**levels):
        own = held.pop(node)
        if len(own):
            dim = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            splits[node] = dim, np.median(own[:, dim])
        left = own[:, int(splits[node, 0])] < splits[node, 1]
        held[2 * node], held[2 * node + 1] = own[left], own[~left]
    return splits


def boxes(splits: np.ndarray, node: int, low: np.ndarray, high: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Boxes of the nodes ``levels`` under a node, from left to right."""
    low, high = low[None], high[None]
    for level in range(levels):
        dim, value = splits[np.arange(node << level, (node + 1) << level)].T
        at = np.arange(len(low)), dim.astype(np.int64)
        low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
        high[2 * at[0], at[1]], low[2 * at[0] + 1, at[1]] = value, value
    return low, high


class Cells:
    """A kd-tree over cells: ``top`` levels, and ``deep`` ones under each of their nodes."""

    def __init__(self, splits: np.ndarray, top: int, deep: int, dims: int = DIMS):
        self.splits, self.top, self.deep = splits, top, deep
        #: Boxes of the nodes ``top`` levels down: as the splits cut them until ``fit`` has them tight.
        self.low, self.high = boxes(splits, 1, np.full(dims, -np.inf), np.full(dims, np.inf), top)

    def fit(self, node: np.ndarray, dim: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Take the least and largest coordinate of the points of each node; a node without points is infinitely far."""
        self.low, self.high = np.full(self.low.shape, np.inf), np.full(self.high.shape, -np.inf)
        self.low[node, dim], self.high[node, dim] = low, high

    def of(self, points: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The cell of each point, or its node ``levels`` down."""
        levels = self.top + self.deep if levels is None else levels
        node = np.ones(len(points), np.int64)
        for _ in range(levels):
            dim, value = self.splits[node, 0].astype(np.int64), self.splits[node, 1]
            node = 2 * node + (points[np.arange(len(points)), dim] >= value)
        return node - 2**levels

    def near(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, place) of squared distance ``reach`` at most, place being the cell's among all by distance; first by the upper levels' boxes."""
        low, high = self.low, self.high
        asked, to, apart = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        inside = box_distance(queries, low, high) <= reach[:, None]
        for i in np.flatnonzero(inside.any(axis=0)):
            own = np.flatnonzero(inside[:, i])
            far = box_distance(queries[own], *boxes(self.splits, 2**self.top + i, low[i], high[i], self.deep))
            q, cell = np.nonzero(far <= reach[own][:, None])
            asked.append(own[q])
            to.append(cell + (i << self.deep))
            apart.append(far[q, cell])
        asked, to, apart = map(np.concatenate, (asked, to, apart))
        order = np.lexsort((to, apart, asked))
        asked, to = asked[order], to[order]
        # All nearer cells are within reach as well, so the place among these is the place among all.
        starts = np.searchsorted(asked, np.arange(len(queries)))
        return asked, to, np.arange(len(asked)) - starts[asked]


def box_distance(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    total = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        q = queries[:, d][:, None]
        total += np.maximum(np.maximum(low[:, d] - q, q - high[:, d]), 0) ** 2
    return total


def search(vectors: np.ndarray, points: np.ndarray, keys: np.ndarray, queries: np.ndarray, at: np.ndarray, least: np.ndarray, k: int, norm: float, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in ``vectors``) and inner products of the k best of each query, place -1 where there are fewer, and how many vectors it verified.

    ``points`` and ``at`` are projections, ``queries`` have norm ``norm``, ``keys`` break ties, and
    ``least`` is the k-th best inner product that each query knows already.
    """
    leaves = list(split(points, np.arange(len(points)), LEAF))
    width = max(map(len, leaves))
    members = np.full((len(leaves), width), -1)
    for i, leaf in enumerate(leaves):
        members[i, : len(leaf)] = leaf
    low = np.stack([points[leaf].min(axis=0) for leaf in leaves])
    high = np.stack([points[leaf].max(axis=0) for leaf in leaves])
    places, scores, verified = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf), np.zeros(len(queries), np.int64)
    for first in range(0, len(queries), TOGETHER):
        part = slice(first, first + TOGETHER)
        q, own, best_at, best, count = queries[part], at[part], places[part], scores[part], verified[part]
        far = box_distance(own, low, high)
        order = np.argsort(far, axis=1)
        known = least[part].copy()
        rows = np.arange(len(q))
        for step in range(len(leaves)):
            leaf = order[rows, step]
            reach = stop * np.maximum(2 * norm * norm - 2 * np.maximum(known, best[:, -1]), 0)[rows]
            going = far[rows, leaf] <= reach
            rows, leaf, reach = rows[going], leaf[going], reach[going]
            if not len(rows):
                break
            new_at = members[leaf]
            apart = ((points[new_at] - own[rows][:, None]) ** 2).sum(axis=2)
            row, place = np.nonzero((new_at >= 0) & (apart <= reach[:, None]))
            if not len(row):
                continue
            new = np.full(new_at.shape, -np.inf)
            new[row, place] = np.einsum("nd,nd->n", vectors[new_at[row, place]], q[rows[row]])
            count += np.bincount(rows[row], minlength=len(q))
            some = np.unique(row)
            rows_of, new, new_at = rows[some], new[some], np.where(np.isinf(new), -1, new_at)[some]
            all_at, every = np.concatenate([best_at[rows_of], new_at], axis=1), np.concatenate([best[rows_of], new], axis=1)
            tie = np.where(all_at < 0, np.iinfo(np.int64).max, keys[all_at])
            top = np.lexsort((tie, -every), axis=1)[:, :k]
            best_at[rows_of], best[rows_of] = np.take_along_axis(all_at, top, 1), np.take_along_axis(every, top, 1)
    return places, scores, verified


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), the vector's key h1, h2, and norm of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(sound & F.exists("embedding", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2"), norm.alias("norm"))


def points_of(rows: DataFrame, is_query, k: int) -> DataFrame:
    """One row per different vector: h1, h2, embedding, norm, ids (its k + 1 smallest) and asked."""
    few = rows.select("h1", "h2", "vec_id", F.pmod("vec_id", F.lit(64)).alias("salt"))
    for key in (["h1", "h2", "salt"], ["h1", "h2"]):
        few = few.withColumn("nth", F.dense_rank().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    ids = few.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    asked = rows.groupBy("h1", "h2").agg(F.max(is_query).alias("asked"), F.min("vec_id").alias("first"))
    heads = ids.join(asked, ["h1", "h2"])
    one = rows.join(heads.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("first").alias("vec_id"), "ids", "asked"), "vec_id")
    return one.where("h1 = _h1 and h2 = _h2").dropDuplicates(["h1", "h2"]).select("h1", "h2", "embedding", "norm", "ids", "asked")


def _matrix(column, width: int) -> np.ndarray:
    """Vectors of a list column, padded with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _project(vectors: np.ndarray, norm: float, queries: bool = False) -> np.ndarray:
    """Projections of rows, or of queries scaled to the largest norm."""
    if queries:
        extra = np.zeros(len(vectors))
    else:
        extra = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return np.c_[vectors, extra] @ directions(vectors.shape[1])


def _scaled(vectors: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    own = np.sqrt((vectors * vectors).sum(axis=1))
    return vectors * (norm / own)[:, None], own


def _tree(points: DataFrame, n: int, width: int, norm: float, cell: int, top: int) -> Cells:
    """The cells' kd-tree; its splits, 2^(2 * top) at most, come to the driver."""

    def projected(rows: pa.Table) -> np.ndarray:
        return _project(_matrix(rows.column("embedding"), width), norm)

    sample = points.orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(SAMPLE).select("embedding").toArrow()
    levels = max(0, math.ceil(math.log2(n / cell)))
    upper = min(levels, top)
    tree = Cells(fitted(projected(sample), upper), upper, 0)
    deep = min(levels - upper, top)
    if not deep:
        return tree
    part = min(1.0, SAMPLE * 2.0**upper / n)
    some = points.where(F.pmod(F.xxhash64("h2", "h1"), F.lit(1 << 20)) < F.lit(math.ceil(part * (1 << 20)))).select("embedding")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _project(_matrix(batch.column("embedding"), width), norm)
                yield pa.RecordBatch.from_arrays([pa.array(tree.of(own)), pa.array(own.tolist(), pa.list_(pa.float64()))], ["node", "at"])

    def under(group: pa.Table) -> pa.Table:
        splits = fitted(_matrix(group.column("at"), DIMS), deep)[1:]
        number, level = np.arange(1, 2**deep), np.log2(np.arange(1, 2**deep)).astype(np.int64)
        node = ((2**upper + group.column("node")[0].as_py()) << level) + number - (1 << level)
        return pa.table([node, splits[:, 0], splits[:, 1]], ["node", "dim", "value"])

    rows = some.mapInArrow(placed, "node long, at array<double>").groupBy("node").applyInArrow(under, "node long, dim double, value double").toArrow()
    splits = np.zeros((2 ** (upper + deep), 2))
    splits[: 2**upper] = tree.splits
    splits[rows.column("node").to_numpy()] = np.c_[rows.column("dim").to_numpy(), rows.column("value").to_numpy()]
    return Cells(splits, upper, deep)


class Search:
    """One search: ``found`` has h1, h2 (the query's), score, ids and verified of what each block found.

    ``points``, ``queries`` and ``cells`` are counts, and ``sent`` how many copies of queries went to other blocks.
    """

    def __init__(self, vectors: DataFrame, is_query, k: int = K, confidence: float = CONFIDENCE, cell: int = CELL, top: int = TOP, near: int = NEAR):
        self.rows = cut(usable(vectors))
        self.found, self.sent, self.cells = None, 0, 0
        points = cut(points_of(self.rows, is_query, k))
        total = points.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.max("norm").alias("norm"), F.count_if("asked").alias("asked")).first()
        self.points, self.queries = total.n, total.asked
        if total.n:
            self._run(points, total, k, chi_square_quantile(confidence), cell, top, near)

    def share(self) -> float:
        """Which part of all pairs of a query and a different vector was verified."""
        return self.found.agg(F.sum("verified")).first()[0] / (self.points * self.queries) if self.queries else 0.0

    def _run(self, points: DataFrame, total, k: int, stop: float, cell: int, top: int, near: int) -> None:
        width, norm = total.width, total.norm
        fitted_tree = _tree(points, total.n, width, norm, cell, top)

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full((2**fitted_tree.top, DIMS), np.inf), np.full((2**fitted_tree.top, DIMS), -np.inf)
            for batch in batches:
                if batch.num_rows:
                    own = _project(_matrix(batch.column("embedding"), width), norm)
                    node = fitted_tree.of(own, fitted_tree.top)
                    np.minimum.at(low, node, own)
                    np.maximum.at(high, node, own)
            node, dim = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(dim), pa.array(low[node, dim]), pa.array(high[node, dim])], ["node", "dim", "low", "high"])

        # A row for each dimension of 2^top nodes at most comes to the driver.
        tight = points.select("embedding").mapInArrow(ends, "node long, dim long, low double, high double").groupBy("node", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        fitted_tree.fit(*(tight.column(c).to_numpy() for c in ("node", "dim", "low", "high")))
        tree = points.sparkSession.sparkContext.broadcast(fitted_tree)

        def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = tree.value.of(_project(_matrix(batch.column("embedding"), width), norm)) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], [*batch.schema.names, "cell"])

        placed = cut(points.mapInArrow(celled, "h1 long, h2 long, embedding array<double>, norm double, ids array<long>, asked boolean, cell int"))
        # A cell of more than twice the intended size is dealt into blocks; there are few, as splits are medians.
        counts = cut(placed.groupBy("cell").agg(F.count("*").alias("n")))
        self.cells = counts.count()
        large = counts.where(F.col("n") > 2 * cell).select("cell", F.ceil(F.col("n") / cell).cast("int").alias("blocks"))
        blocks = {r.cell: r.blocks for r in large.collect()}
        placed = placed.join(large, "cell", "left").withColumn("block", F.pmod("h1", F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")

        def block_search(points: pa.Table, queries: pa.Table, least: np.ndarray) -> pa.Table:
            if not len(queries) or not len(points):
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.int64())], ["h1", "h2", "score", "ids", "verified"])
            x, (q, own) = _matrix(points.column("embedding"), width), _scaled(_matrix(queries.column("embedding"), width), norm)
            ids = points.column("ids").combine_chunks()
            first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            places, scores, verified = search(x, _project(x, norm), first, q, _project(q, norm, True), least, k + 1, norm, stop)
            asker, nth = np.nonzero(places >= 0)
            found = places[asker, nth]
            # Exactly the inner product of the vectors as they are.
            score = np.einsum("nd,nd->n", x[found], _matrix(queries.column("embedding"), width)[asker])
            keys = [queries.column(c).take(pa.array(asker)) for c in ("h1", "h2")]
            return pa.table([*keys, pa.array(score), ids.take(pa.array(found)), pa.array(np.where(nth == 0, verified[asker], 0))], ["h1", "h2", "score", "ids", "verified"])

        found_schema = "h1 long, h2 long, score double, ids array<long>, verified long"

        def at_home(group: pa.Table) -> pa.Table:
            queries = group.filter(group.column("asked"))
            return block_search(group, queries, np.full(len(queries), -np.inf))

        self.found = cut(placed.groupBy("cell", "block").applyInArrow(at_home, found_schema))
        if self.cells == 1 and not blocks:
            return
        for wave in range(2):
            # The k-th best score of each query so far, when it has that many.
            best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), F.col("ids")[0])
            known = self.found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).groupBy("h1", "h2").agg(F.when(F.count("*") >= k + 1, F.min("score")).alias("least"))
            asked = placed.where("asked").join(known, ["h1", "h2"]).select("h1", "h2", "embedding", "norm", "least", "cell", "block")

            def routed(batches: Iterator[pa.RecordBatch], wave: int = wave) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    q, own = _scaled(_matrix(batch.column("embedding"), width), norm)
                    least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    scaled = np.where(np.isnan(least), -norm * norm, least * norm / own)
                    asker, to, place = tree.value.near(_project(q, norm, True), stop * np.maximum(2 * norm * norm - 2 * scaled, 0))
                    # The first wave takes the nearest cells; the second one what the nearer bound still leaves of the others.
                    turn = place < near if wave == 0 else place >= near
                    asker, to = asker[turn], to[turn]
                    home_cell, home_block = batch.column("cell").to_numpy(), batch.column("block").to_numpy()
                    many = np.array([blocks.get(int(c), 1) for c in to], np.int64)
                    asker, to, number = np.repeat(asker, many), np.repeat(to, many), np.concatenate([np.arange(m) for m in many] or [np.zeros(0, np.int64)])
                    away = (to != home_cell[asker]) | (number != home_block[asker])
                    asker, to, number = asker[away], to[away], number[away]
                    cols = [batch.column(c).take(pa.array(asker)) for c in ("h1", "h2", "embedding")]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array(scaled[asker]), pa.array(to.astype(np.int32)), pa.array(number.astype(np.int32))], ["h1", "h2", "embedding", "least", "cell", "block"]
                    )

            sent = cut(asked.mapInArrow(routed, "h1 long, h2 long, embedding array<double>, least double, cell int, block int"))
            groups = cut(sent.groupBy("cell", "block").agg(F.count("*").alias("n"), F.ceil(F.count("*") / ASKED).cast("int").alias("groups")))
            copies = groups.agg(F.sum("n")).first()[0]
            if not copies:
                continue
            self.sent += copies
            sent = sent.join(groups.drop("n"), ["cell", "block"]).withColumn("group", F.pmod("h2", "groups").cast("int"))
            visited = placed.join(groups.drop("n"), ["cell", "block"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

            def away(queries: pa.Table, points: pa.Table) -> pa.Table:
                return block_search(points, queries, queries.column("least").to_numpy())

            by = ["cell", "block", "group"]
            elsewhere = sent.drop("groups").groupBy(*by).cogroup(visited.drop("groups").groupBy(*by)).applyInArrow(away, found_schema)
            self.found = self.found.union(cut(elsewhere))


def nearest(vectors: DataFrame, is_query, k: int = K, confidence: float = CONFIDENCE, cell: int = CELL, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score: the k found of each row for which ``is_query`` (over vec_id) holds."""
    done = Search(vectors, is_query, k, confidence, cell, top)
    if done.found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("h1", "h2")
    tops = done.found.drop("verified").withColumn("nth", F.row_number().over(best.orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("nth") <= k + 1)
    tops = tops.select("h1", "h2", "score", F.explode("ids").alias("vec_id")).withColumn("nth", F.row_number().over(best.orderBy(F.desc("score"), "vec_id"))).where(F.col("nth") <= k + 1)
    lists = tops.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    queries = done.rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    own = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return queries.join(lists, ["h1", "h2"]).select("query_id", F.posexplode(own).alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
