"""Operator 12: exact search for the largest inner products by kd-trees per shard.

Components become integers, floor(64 * x). Rows lie in cells, which a kd-tree of median splits over ``SAMPLE``
rows cuts out, and cells of more than ``SHARD`` rows in shards by a hash of vec_id. A task builds
the kd-tree of one shard: halves along the widest dimension down to leaves of ``LEAF`` rows, each
node with the tight box of its rows. The largest inner product that a query can have with a row of a box
is the sum over dimensions of the larger one of q * low and q * high: boxes under a query's k-th best
score are left out with all below them, the leaves that remain are visited best bound first, each with a
few queries at a time, and the k-th best score rises on the way. A query is searched in its own shard
first, then in the ``NEAR`` cells of best bound, then in all others whose box may hold something
as good as its k-th best score so far, which goes along to every shard. A box whose bound equals the score is
visited, as it may hold a smaller vec_id.

How it runs at scale: trees are built where a shard lies, in memory that ``SHARD`` bounds, and
are no larger than it. What the driver sees is bounded: ``SAMPLE`` rows, and the size and box of each of
at most 2^``TOP`` cells. Queries of one shard are dealt to groups of ``ASKED``. Of uniformly spread vectors
of many dimensions no box can be left out: then every query meets every shard, in blocks, as an
exact answer needs there; on clustered vectors most cells are left out (``tests/llm`` count them).

Defined cases: a null vector, a null or non-finite component or a null vec_id keeps a row out; zero vectors
and empty ones take part; shorter vectors count as padded with zeros; rows equal in id and vector
count once, and different vectors of one id are searched one by one, none finding its own id; fewer
candidates than k give shorter lists; further columns are ignored; an empty table gives an empty result.
Products that do not fit a long are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.neighbours import Cells, fitted
from tessera.llm.vectors import integers, matrix

K, EVERY, SCALE = 20, 20, 64
#: Rows that the cells are fitted on, rows in a shard, levels of the cells' tree at most, rows in a leaf.
SAMPLE, SHARD, TOP, LEAF = 8192, 8192, 10, 128
#: Queries of one group, and cells that a query visits before its k-th best score is taken anew.
ASKED, NEAR = 2048, 3
_LEAST = np.iinfo(np.int64).min


class Tree:
    """A kd-tree over integer rows: ``levels`` has the boxes (low, high) of each level, ``leaves`` the rows of the last one.

    Children of node i are 2i and 2i + 1 of the next level; leaves have two rows at least, but for a single row.
    """

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = [np.arange(len(rows))]
        while True:
            self.levels.append((np.stack([rows[n].min(axis=0) for n in nodes]), np.stack([rows[n].max(axis=0) for n in nodes])))
            # Sizes of a level differ by one at most and the first is the largest, so all nodes of a level are split alike.
            if len(nodes[0]) <= leaf:
                break
            halves = []
            for n, low, high in zip(nodes, *self.levels[-1], strict=True):
                middle = -(-len(n) // 2)
                order = np.argpartition(rows[n, int(np.argmax(high - low))], middle)
                halves += [n[order[:middle]], n[order[middle:]]]
            nodes = halves
        self.leaves = nodes


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any point of each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _exact(rows: np.ndarray, queries: np.ndarray) -> type:
    """The number type in which all products are exact: doubles where they suffice, as they are faster."""
    largest = max(1, rows.shape[1]) * int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0))
    if largest >= 2**62:
        raise OverflowError("inner products do not fit a long")
    return np.float64 if largest < 2**52 else np.int64


def search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of the k best rows of each query that reach its score ``least``, and how many pairs were compared.

    ``own`` is each query's vec_id, which it does not find.
    """
    kind = _exact(rows, queries)
    tree = Tree(rows, leaf)
    x, q = rows.astype(kind), queries.astype(kind)
    known = np.where(least == _LEAST, -(2.0**62), least).astype(kind)
    alive = np.ones((len(q), 1), bool)
    for low, high in tree.levels:
        alive = np.repeat(alive, len(low) // alive.shape[1], axis=1)
        reach = np.full(alive.shape, -(2.0**62), kind)
        asked, open_ = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        reach[np.ix_(asked, open_)] = bounds(q[asked], low[open_].astype(kind), high[open_].astype(kind))
        alive &= reach >= known[:, None]
    order = np.argsort(np.where(alive, -reach, np.inf), axis=1, kind="stable")
    many = alive.sum(axis=1)
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    compared = 0
    for step in range(many.max(initial=0)):
        going = np.flatnonzero(many > step)
        to = order[going, step]
        going, to = going[(fits := reach[going, to] >= known[going])], to[fits]
        # Bounds fall from step to step and the k-th score rises, so who stops here is done.
        many[np.setdiff1d(np.flatnonzero(many > step), going)] = 0
        if not len(going):
            break
        found = [best]
        by_leaf = np.argsort(to, kind="stable")
        for group in np.split(by_leaf, np.flatnonzero(np.diff(to[by_leaf])) + 1):
            asked, members = going[group], tree.leaves[to[group[0]]]
            scores = q[asked] @ x[members].T
            compared += scores.size
            hit, at = np.nonzero((scores >= known[asked][:, None]) & (ids[members][None] != own[asked][:, None]))
            found.append((asked[hit], members[at], scores[hit, at]))
        best = _k_best(*(np.concatenate(c) for c in zip(*found, strict=True)), ids, k)
        last = np.flatnonzero(best[3] == k - 1)
        known[best[0][last]] = np.maximum(known[best[0][last]], best[2][last])
        best = best[:3]
    return best[0], best[1], best[2].astype(np.int64), compared


def _k_best(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query with their places (from 0), ties to the smaller id."""
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    top = place < k
    return query[top], row[top], score[top], place[top]


_FOUND = "query_id long, h1 long, h2 long, vec_id long, score long"
_KEY = ["query_id", "h1", "h2"]


def _searched(points: pa.Table, queries: pa.Table, least: np.ndarray, width: int, k: int) -> pa.Table:
    names = [c.split(" ")[0] for c in _FOUND.split(", ")]
    if not len(points) or not len(queries):
        return pa.table([pa.array([], pa.int64())] * len(names), names)
    ids, own = points.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    query, row, score, _ = search(matrix(points.column("v"), width), ids, matrix(queries.column("v"), width), own, least, k)
    at = pa.array(query)
    return pa.table([pa.array(own[query]), queries.column("h1").take(at), queries.column("h2").take(at), pa.array(ids[row]), pa.array(score)], names)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank."""
    order = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Search:
    """One search of all queries: ``found`` has what each wave found, ``sent`` how many copies of queries went to other shards."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int = K, shard: int = SHARD, scale: int = SCALE, near: int = NEAR, top: int = TOP):
        self.k, self.near, self.found, self.sent = k, near, None, 0
        rows = integers(vectors, scale).where("vec_id is not null")
        rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")).dropDuplicates(["vec_id", "h1", "h2"])
        rows = cut(rows.withColumn("asked", F.coalesce(is_query, F.lit(False))))
        total = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if("asked").alias("asked")).first()
        self.rows, self.width, self.asked = total.n, total.width, total.asked
        if total.asked:
            self._run(rows, shard, top)

    def _run(self, rows: DataFrame, shard: int, top: int) -> None:
        spark, width, k = rows.sparkSession, self.width, self.k
        sample = rows.orderBy(F.xxhash64("vec_id"), "h1").limit(SAMPLE).select("v").toArrow()
        levels = min(top, max(0, math.ceil(math.log2(self.rows / shard)))) if width else 0
        cells = Cells(fitted(matrix(sample.column("v"), width).astype(float), levels) if levels else np.zeros((1, 2)), levels, 0, width)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = cells.of(matrix(batch.column("v"), width).astype(float)) if levels else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

        def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                x, cell = matrix(batch.column("v"), width), batch.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    own = x[cell == c]
                    low, high, n = held.get(c, (own[0], own[0], 0))
                    held[c] = np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0)), n + len(own)
            for c, (low, high, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, c, np.int32)), pa.array(np.arange(-1, width, dtype=np.int32)), pa.array(np.r_[n, low]), pa.array(np.r_[n, high])], ["cell", "dim", "low", "high"])

        rows = cut(rows.mapInArrow(placed, "vec_id long, v array<long>, h1 long, h2 long, asked boolean, cell int"))
        ends = rows.select("v", "cell").mapInArrow(boxed, "cell int, dim int, low long, high long").groupBy("cell", "dim")
        # One row for each dimension of each of 2^top cells at most.
        ends = ends.agg(F.sum("low").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell", "dim").toArrow()
        at = ends.column("dim").to_numpy() < 0
        number = ends.column("cell").to_numpy()[at]
        low, high = (ends.column(c).to_numpy()[~at].reshape(len(number), width) for c in ("low", "high"))
        shards = -(-ends.column("n").to_numpy()[at] // shard)
        dealt = spark.createDataFrame([(int(c), int(s)) for c, s in zip(number, shards, strict=True)], "cell int, shards int")
        points = cut(rows.join(F.broadcast(dealt), "cell").withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int")).drop("shards"))

        def at_home(group: pa.Table) -> pa.Table:
            queries = group.filter(group.column("asked"))
            return _searched(group, queries, np.full(len(queries), _LEAST), width, k)

        self.found = cut(points.groupBy("cell", "shard").applyInArrow(at_home, _FOUND))
        if shards.sum() == 1:
            return
        kind = np.int64
        tree = spark.sparkContext.broadcast((number, shards, low.astype(kind), high.astype(kind)))
        for wave in range(2):
            near = self.near

            def routes(batch: pa.RecordBatch, wave: int = wave) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Which query of a batch goes to which shard of which cell in this wave."""
                number, shards, low, high = tree.value
                q = matrix(batch.column("v"), width)
                kind = _exact(np.concatenate([low, high]), q)
                reach = bounds(q.astype(kind), low.astype(kind), high.astype(kind))
                order = np.argsort(-reach, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(number))[None].repeat(len(q), axis=0), axis=1)
                # The first wave takes the cells of best bound, by the k-th score of the query's own shard, and the second one the others, by the newer score.
                turn = (place < near) if wave == 0 else (place >= near)
                least = batch.column("least").to_numpy(zero_copy_only=False)
                query, cell = np.nonzero(turn & (reach >= np.where(np.isnan(least), -(2.0**62), least)[:, None]))
                many = shards[cell]
                query, to = np.repeat(query, many), np.repeat(number[cell], many)
                part = np.concatenate([np.arange(m) for m in many] or [np.zeros(0, np.int64)])
                away = (to != batch.column("cell").to_numpy()[query]) | (part != batch.column("shard").to_numpy()[query])
                return query[away], to[away], part[away]

            def counted(batches: Iterator[pa.RecordBatch], routes=routes) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, to, part = routes(batch)
                    keys, n = np.unique(np.c_[to, part], axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1].astype(np.int32)), pa.array(n)], ["cell", "shard", "n"])

            def sent(batches: Iterator[pa.RecordBatch], routes=routes) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    query, to, part = routes(batch)
                    # A few copies at a time, so that no batch holds all of a query's.
                    for i in range(0, len(query), ASKED):
                        rows = batch.select(["vec_id", "v", "h1", "h2", "least"]).take(pa.array(query[i : i + ASKED]))
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to[i : i + ASKED].astype(np.int32)), pa.array(part[i : i + ASKED].astype(np.int32))], [*rows.schema.names, "cell", "shard"])

            known = _best(self.found, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "h1", "h2", F.col("score").cast("double").alias("least"))
            queries = cut(points.where("asked").join(known, ["vec_id", "h1", "h2"], "left").select("vec_id", "v", "h1", "h2", "cell", "shard", "least"))
            groups = cut(queries.mapInArrow(counted, "cell int, shard int, n long").groupBy("cell", "shard").agg(F.sum("n").alias("n"), F.ceil(F.sum("n") / ASKED).cast("int").alias("groups")))
            copies = groups.agg(F.sum("n")).first()[0] or 0
            self.sent += copies
            if not copies:
                continue
            asked = queries.mapInArrow(sent, "vec_id long, v array<long>, h1 long, h2 long, least double, cell int, shard int")
            asked = asked.join(groups, ["cell", "shard"]).select("vec_id", "v", "h1", "h2", "least", "cell", "shard", F.pmod("h2", "groups").cast("int").alias("group"))
            visited = points.join(groups, ["cell", "shard"]).select("vec_id", "v", "cell", "shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))

            def away(queries: pa.Table, points: pa.Table) -> pa.Table:
                least = queries.column("least").to_numpy(zero_copy_only=False)
                return _searched(points, queries, np.where(np.isnan(least), _LEAST, np.nan_to_num(least)).astype(np.int64), width, k)

            by = ["cell", "shard", "group"]
            self.found = self.found.union(cut(asked.groupBy(*by).cogroup(visited.groupBy(*by)).applyInArrow(away, _FOUND)))


def top_scores(vectors: DataFrame, is_query: Column, k: int = K, **settings) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of each row for which ``is_query`` (over vec_id) holds."""
    done = Search(vectors, is_query, k, **settings)
    if done.found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _best(done.found, k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the 20 best rows of every vector whose id is divisible by 20."""
    return top_scores(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = """
WITH given AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, q.v, d.vec_id, CAST(list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[]) AS BIGINT) AS score FROM given q JOIN given d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs QUALIFY rank <= 20"""
