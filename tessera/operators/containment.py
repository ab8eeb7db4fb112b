"""Which items' texts stand inside which documents, found through short pieces and then checked.

A piece of each item is an equi-join key: its first inner words (the outer ones may stand glued to
others in a document), or its first characters where it has no inner words. Keys travel without the
texts; only candidate pairs fetch them for the final check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and characters of a key at most.
WORDS, CHARACTERS = 4, 3
_WORD = r"[^\x20\x09-\x0D]+"


def _runs(array: str, n: int, between: str):
    """All runs of n neighbours of an array column, each once."""
    whole = F.col(array)
    run = F.transform(whole, lambda x, i: F.concat_ws(between, x, *[F.get(whole, i + k) for k in range(1, n)]))
    return F.when(F.size(whole) >= n, F.array_distinct(F.slice(run, 1, F.size(whole) - (n - 1)))).otherwise(F.array().cast("array<string>"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item of all pairs in which a document's ``text`` contains an item's ``passage``; empty passages stand nowhere."""
    rows = items.select("item", "passage").where(F.length("passage") > 0).distinct()
    inner = F.regexp_extract_all("passage", F.lit(_WORD), F.lit(0))
    inner = F.slice(inner, 2, F.greatest(F.lit(0), F.size(inner) - 2))
    size = F.least(F.lit(WORDS), F.size(inner))
    rows = rows.select("item", "passage", size.alias("n"), F.array_join(F.slice(inner, 1, size), " ").alias("few"))
    rows = rows.select("item", "passage", F.when(F.col("n") > 0, F.col("n")).otherwise(-F.least(F.lit(CHARACTERS), F.length("passage"))).alias("kind"), F.when(F.col("n") > 0, F.col("few")).otherwise(F.substring("passage", 1, CHARACTERS)).alias("key"))
    # Words and characters are columns of their own, so no lambda cuts the text anew for each place.
    split = {True: F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), False: F.split("text", "")}
    candidates = None
    for r in sorted(rows.select("kind").distinct().collect()):  # WORDS + CHARACTERS at most
        parts = docs.select("doc_id", split[r.kind > 0].alias("_parts"))
        found = parts.select("doc_id", F.explode(_runs("_parts", abs(r.kind), " " if r.kind > 0 else "")).alias("key")).join(rows.where(F.col("kind") == r.kind).select("item", "key"), "key").select("doc_id", "item")
        candidates = found if candidates is None else candidates.union(found)
    if candidates is None:
        return docs.join(rows, F.lit(False)).select("doc_id", "item")
    pairs = candidates.distinct().join(rows.select("item", "passage"), "item")
    return pairs.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("doc_id", "item").distinct()
