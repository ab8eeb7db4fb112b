"""Retrieval: BM25, dense search, rank and score fusion, gates, boosts and expansion.

Rankings are DataFrames (qid, doc_id, score, rank). Postings join query terms on the term, so only
the postings of asked terms move; lists end in a ranked window whose group limit runs before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dot, half_up, tokens
from tessera.sources.session import guarded

K1, B = 1.2, 0.75
#: Asked terms up to which they are sent to every executor; beyond that tokens meet them by a shuffle.
FEW_TERMS = 100_000
#: Vectors that one block of a dense search holds.
ROWS_IN_BLOCK = 8192


def postings(docs: DataFrame, mode: str = "latin", wanted: DataFrame | None = None) -> DataFrame:
    """term, doc_id, tf and size (the document's number of tokens), of the ``wanted`` terms only where they are given."""
    found = docs.select("doc_id", tokens("text", mode).alias("_t")).select("doc_id", F.size("_t").alias("size"), F.explode("_t").alias("term"))
    if wanted is not None:
        few = wanted.select("term").distinct()
        found = found.join(F.broadcast(few) if few.count() <= FEW_TERMS else few, "term", "left_semi")
    return found.groupBy("term", "doc_id", "size").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, mode: str = "latin") -> DataFrame:
    """One row: documents, tokens and mean size."""
    sizes = docs.select(F.size(tokens("text", mode)).cast("long").alias("size"))
    return sizes.agg(F.count("*").alias("docs"), F.sum("size").alias("tokens"), F.avg("size").alias("mean"))


def top(scored: DataFrame, k: int, by: str = "qid", item: str = "doc_id") -> DataFrame:
    """The k best rows of each group by score, ties to the smaller item, with their rank."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def frequencies(own: DataFrame) -> DataFrame:
    """term and df of postings."""
    # Counting by tf keeps both branches on the same columns, so the postings are made once (ReusedExchange).
    return own.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def ranked(own: DataFrame, df: DataFrame, n: int, mean: float | None, asked: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents of each question by postings, document frequencies, and the number and mean size of documents.

    ``asked`` has qid, term and asked (how often). Scores are rounded to three digits before they are ranked.
    """
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / (mean or 1.0)))
    hits = asked.join(df, "term").join(own, "term")
    return top(hits.groupBy("qid", "doc_id").agg(half_up(F.sum(F.col("asked") * weight), 3).alias("score")), k)


def asked_of(query_terms: DataFrame) -> DataFrame:
    """qid, term and asked: a repeated term of a question counts again."""
    return query_terms.groupBy("qid", "term").agg(F.count("*").alias("asked"))


def bm25(docs: DataFrame, query_terms: DataFrame, k: int, mode: str = "latin", k1: float = K1, b: float = B) -> DataFrame:
    """The k best documents of each question (qid, term rows) over texts that no index is kept of."""
    # The statistics are one row.
    n, _, mean = corpus_stats(docs, mode).first()
    asked = asked_of(query_terms)
    own = postings(docs, mode, asked)
    return ranked(own, frequencies(own), n, mean, asked, k, k1, b)


def dense(queries: DataFrame, vectors: DataFrame, k: int, rows_in_block: int = ROWS_IN_BLOCK) -> DataFrame:
    """The k rows (doc_id, embedding) of largest inner product with each query (qid, embedding), itself apart.

    Rows are dealt into blocks of about ``rows_in_block`` and the stated queries go to each block, so
    no task holds all rows, and there are the more tasks the more rows there are.
    """
    blocks = max(8, -(-vectors.count() // rows_in_block))
    rows = vectors.select("doc_id", F.col("embedding").alias("_row"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("_block"))
    asked = queries.select("qid", F.col("embedding").alias("_query"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("_block"))
    pairs = rows.join(asked, "_block").where("doc_id <> qid").select("qid", "doc_id", half_up(dot("_query", "_row"), 6).alias("score"))
    return top(pairs, k)


def minmax(ranking: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within each question; all 0 where they do not differ."""
    w = Window.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranking.withColumn("score", F.when(high - low < 1e-12, 0.0).otherwise((F.col("score") - low) / (high - low)))


def _joined(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    left = a.select("qid", "doc_id", F.col(column).alias("x"))
    return left.join(b.select("qid", "doc_id", F.col(column).alias("y")), ["qid", "doc_id"], "full")


def fuse_scores(a: DataFrame, b: DataFrame, alpha: float, k: int, scaled: bool = True) -> DataFrame:
    """alpha * a + (1 - alpha) * b over the union of ids; a missing score is 0."""
    both = _joined(minmax(a), minmax(b), "score") if scaled else _joined(a, b, "score")
    score = alpha * F.coalesce("x", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0))
    return top(both.select("qid", "doc_id", half_up(score, 6).alias("score")), k)


def fuse_absolute(a: DataFrame, b: DataFrame, saturation: float, k: int) -> DataFrame:
    """a / (a + saturation) + b, without scaling per question."""
    x = F.coalesce("x", F.lit(0.0))
    score = x / (x + saturation) + F.coalesce("y", F.lit(0.0))
    return top(_joined(a, b, "score").select("qid", "doc_id", half_up(score, 6).alias("score")), k)


def fuse_ranks(channels: list[tuple[DataFrame, float]], constant: float, k: int) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (constant + rank)."""
    parts = [c.select("qid", "doc_id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("s")) for c, w in channels]
    guarded(parts[0].sparkSession)
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return top(every.groupBy("qid", "doc_id").agg(half_up(F.sum("s"), 9).alias("score")), k)


def interleave(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Round robin of two rankings, each document at its first place."""
    guarded(a.sparkSession)
    both = a.select("qid", "doc_id", "rank", F.lit(0).alias("channel")).union(b.select("qid", "doc_id", "rank", F.lit(1).alias("channel")))
    first = both.groupBy("qid", "doc_id").agg(F.min(F.struct("rank", "channel")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at.rank", "at.channel")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("qid", "doc_id", "place")


def peak_ratio(ranking: DataFrame, depth: int = 10) -> DataFrame:
    """qid and peak: the best score over that of rank ``depth`` (or the last)."""
    per = ranking.where(F.col("rank") <= depth).groupBy("qid").agg(F.max("score").alias("best"), F.min_by("score", -F.col("rank")).alias("last"))
    return per.select("qid", half_up(F.when(F.col("last") > 0, F.col("best") / F.col("last")).otherwise(F.lit(0.0)), 6).alias("peak"))


def gated(first: DataFrame, otherwise: DataFrame, gate: DataFrame, threshold: float) -> DataFrame:
    """``first`` for questions whose peak reaches the threshold, ``otherwise`` for the others."""
    guarded(gate.sparkSession)
    sharp = gate.where(F.col("peak") >= threshold).select("qid")
    return first.join(sharp, "qid", "left_semi").unionByName(otherwise.join(sharp, "qid", "left_anti"))


def neighbour_boost(ranking: DataFrame, position: DataFrame, weight: float, k: int) -> DataFrame:
    """Adds ``weight`` times the better score of the previous and next item of the same source.

    ``position`` has doc_id, source and at.
    """
    # Neighbours by their places, so that no task holds a source.
    beside = position.select(F.col("doc_id").alias("neighbour"), F.col("source").alias("_source"), F.explode(F.array(F.col("at") - 1, F.col("at") + 1)).alias("at"))
    near = position.select("doc_id", "source", "at").withColumnRenamed("at", "_at").join(beside, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("at"))).select("doc_id", "neighbour")
    lent = ranking.select("qid", F.col("doc_id").alias("neighbour"), F.col("score").alias("lent"))
    best = near.join(lent, "neighbour").groupBy("qid", "doc_id").agg(F.max("lent").alias("lent"))
    boosted = ranking.join(best, ["qid", "doc_id"], "left")
    return top(boosted.select("qid", "doc_id", half_up(F.col("score") + weight * F.coalesce("lent", F.lit(0.0)), 6).alias("score")), k)


def feedback_terms(ranking: DataFrame, docs: DataFrame, query_terms: DataFrame, depth: int = 3, least: int = 2, take: int = 5) -> DataFrame:
    """qid, term and docs: new terms found in ``least`` or more of the ``depth`` best documents, most frequent first."""
    best = ranking.where(F.col("rank") <= depth).select("qid", "doc_id")
    found = best.join(docs.select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("term")), "doc_id").where(F.length("term") >= 4)
    new = found.join(query_terms.select("qid", "term").distinct(), ["qid", "term"], "left_anti")
    counted = new.groupBy("qid", "term").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    order = Window.partitionBy("qid").orderBy(F.desc("docs"), "term")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def filled_picks(picks: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """A reranker's picks (qid, doc_id, place), filled up from a ranking to k."""
    guarded(ranking.sparkSession)
    rest = ranking.join(picks, ["qid", "doc_id"], "left_anti").select("qid", "doc_id", (F.col("rank") + 1_000_000).alias("place"))
    order = Window.partitionBy("qid").orderBy("place")
    return picks.select("qid", "doc_id", "place").union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "rank")
