"""Retrieval metrics over a ranking (qid, doc_id, rank) and references (qid, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import half_up


def outcomes(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, refs, best (the rank of the first hit) and hits at 1, 3, 5 and 10 of every question with references."""
    marked = gold.join(ranking.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    at = [F.count_if(F.col("rank") <= k).alias(f"hits{k}") for k in (1, 3, 5, 10)]
    return marked.groupBy("qid").agg(F.count("*").alias("refs"), F.min("rank").alias("best"), *at)


def summary(found: DataFrame, layer: str) -> DataFrame:
    """hit@1, hit@3, P@3, R@10 and MRR per layer and over all."""
    every = found.groupingSets([(layer,), ()], layer).agg(
        F.count("*").alias("questions"),
        half_up(F.avg((F.col("hits1") > 0).cast("int")), 4).alias("hit1"),
        half_up(F.avg((F.col("hits3") > 0).cast("int")), 4).alias("hit3"),
        half_up(F.avg(F.col("hits3") / 3), 4).alias("p3"),
        half_up(F.avg(F.col("hits10") / F.col("refs")), 4).alias("r10"),
        half_up(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 4).alias("mrr"),
    )
    return every.withColumn(layer, F.coalesce(layer, F.lit("ALL")))


def threshold_sweep(signal: DataFrame, grid: list[float]) -> DataFrame:
    """Rejection and false rejection of answerable (qid, answerable, signal) at each threshold; no accuracy (NaN) where all or none are answerable."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold")
    per = signal.select("answerable", "signal", steps).groupBy("threshold").agg(
        F.count_if(~F.col("answerable") & (F.col("signal") < F.col("threshold"))).alias("rejected"),
        F.count_if(~F.col("answerable")).alias("unanswerable"),
        F.count_if(F.col("answerable") & (F.col("signal") < F.col("threshold"))).alias("false_rejects"),
        F.count_if("answerable").alias("answerable"),
    )
    rejection, wrong = F.col("rejected") / F.col("unanswerable"), F.col("false_rejects") / F.col("answerable")
    accuracy = F.when((F.col("unanswerable") > 0) & (F.col("answerable") > 0), half_up((rejection + 1 - wrong) / 2, 4)).otherwise(F.lit(float("nan")))
    return per.select("threshold", "rejected", "false_rejects", accuracy.alias("balanced_accuracy"))
