"""Which names of a dictionary stand in which texts, by an automaton, and the nodes that they name.

Names are matched anywhere in a normalised text, as a name may be part of a longer word. All names
of a dictionary of ``BROADCAST`` characters at most go to every executor, where one automaton reads each text
once, however many names there are. A larger dictionary is dealt into shards of that size: each is an automaton
of its own task group, and texts are read once for each shard. Names are listed longest
first, ties in order of the name, which is the order in which a reader prefers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of the names that one automaton holds.
BROADCAST = 8_000_000
_MENTIONS = "doc_id long, name string, at int, times int"


def automaton(names: list[str]):
    """An automaton that yields (end, name) of each place where a name stands."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, name)
    found.make_automaton()
    return found


def _found(names: list[str]):
    """A function over batches (doc_id, text): each name that a text holds, where it first starts, and how often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(names)
        for batch in batches:
            docs, words, places, times = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own: dict[str, list[int]] = {}
                for end, name in machine.iter(text or ""):
                    own.setdefault(name, [end - len(name) + 1, 0])[1] += 1
                docs += [doc] * len(own)
                words += own
                places += [x[0] for x in own.values()]
                times += [x[1] for x in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(words, pa.string()), pa.array(places, pa.int32()), pa.array(times, pa.int32())], ["doc_id", "name", "at", "times"])

    return scan


def mentions(docs: DataFrame, names: DataFrame, size: int = BROADCAST) -> DataFrame:
    """doc_id, name, at (its first place, from 0) and times of each ``name`` that the ``text`` of a document (doc_id) holds."""
    given = names.select("name").where("length(name) > 0").distinct()
    total = given.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = max(1, -(-total // size))
    found = None
    for i in range(shards):
        # One shard's names at a time, of ``size`` characters or so.
        own = given if shards == 1 else given.where(F.pmod(F.xxhash64("name"), F.lit(shards)) == i)
        here = texts.mapInArrow(_found([r.name for r in own.collect()]), _MENTIONS) if total else texts.limit(0).select("doc_id", F.lit("").alias("name"), F.lit(0).alias("at"), F.lit(0).alias("times"))
        found = here if found is None else found.unionByName(here)
    return found


def longest_first(found: DataFrame, by: str = "doc_id") -> DataFrame:
    """Adds ``place`` (from 1) of each name among those of a document: longest first, then in order."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.length("name")), "name")))


def nodes_in(found: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, node and name: the nodes (``entries`` has node and name) that the names found stand for, each by the name that comes first."""
    named = found.join(entries, "name").withColumn("long", -F.length("name"))
    best = named.groupBy("doc_id", "node").agg(F.min(F.struct("long", "name")).alias("b"))
    return best.select("doc_id", "node", F.col("b.name").alias("name"))
