"""Operator 7: cost-balanced packing of whole documents into sequences of bounded length.

A sequence costs ``LINEAR`` for each token plus ``QUADRATIC`` for each pair of tokens of one
piece, as attention inside a document does. A document's full stretches of ``CAPACITY`` (1024)
ids are sequences of their own; the ends that remain are packed in shards of about
``SHARD_TOKENS`` ids: ``SLACK`` (2 %) more room than their ids need is opened, and the pieces go,
longest first, each whole to the sequence of lowest cost that has room. A piece that fits nowhere is
cut: it fills the largest rooms, and its rest goes to the smallest room that holds it. A sequence
that stays short of ``CAPACITY`` by more than a ``SHORT`` part (1/16), as in shards of few ids, is
cut to powers of two, which need no padding. So about ``SLACK`` of the ids is padded.

How it runs: one pass in tasks over whole texts, with no shuffle; a shard is a bounded stretch of
one input partition. Sequence ids combine partition and sequence, so a task that runs again on
another executor gives the same ones.

Defined cases: a null text is the empty text, which is the end id 0 alone; each row is a document
of its own, also with an equal or null ``doc_id``; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty
from tessera.llm.encoding import Encoder

CAPACITY, END = 1024, 0
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SHARD_TOKENS = 1_000_000
#: Room beyond the ids of a shard; the part of a sequence from which missing ids are not padded.
SLACK, SHORT = 0.02, 1 / 16
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: int) -> float:
    """What one piece of a sequence costs."""
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[int], capacity: int = CAPACITY, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length) that hold every unit of every item once.

    Items are shorter than ``capacity``.
    """
    n = -(-int(sum(lengths) * (1 + slack)) // capacity) or int(bool(lengths))
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    room, load = np.full(n, capacity), np.zeros(n)
    unplaced = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        length = lengths[item]
        i = int(np.argmin(np.where(room >= length, load, np.inf)))
        if room[i] < length:
            unplaced.append(item)
            continue
        sequences[i].append((item, 0, length))
        room[i] -= length
        load[i] += cost(length)
    rooms = sorted((int(r), i) for i, r in enumerate(room) if r)
    for item in unplaced:
        start = 0
        while start < lengths[item]:
            left = lengths[item] - start
            at = min(bisect.bisect_left(rooms, (left, -1)), len(rooms) - 1)
            space, i = rooms.pop(at)
            length = min(space, left)
            sequences[i].append((item, start, length))
            start += length
            if space > length:
                bisect.insort(rooms, (space - length, i))
    return [s for s in sequences if s]


def without_short(sequences: list[list[tuple[int, int, int]]], capacity: int = CAPACITY, short: float = SHORT) -> Iterator[list[tuple[int, int, int]]]:
    """The same pieces, with short sequences cut to powers of two."""
    for pieces in sequences:
        left = sum(p[2] for p in pieces)
        if capacity - left <= short * capacity:
            yield pieces
            continue
        at, done = 0, 0
        while left:
            size = 1 << (left.bit_length() - 1)
            filled, sequence = 0, []
            while filled < size:
                item, start, length = pieces[at]
                take = min(length - done, size - filled)
                sequence.append((item, start + done, take))
                filled, done = filled + take, done + take
                if done == length:
                    at, done = at + 1, 0
            yield sequence
            left -= size


class Packer:
    """Packs the documents of one task; ``rows`` are (document, start, length, sequence, offset)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.sequence, self.capacity = first_sequence, capacity

    def shard(self, sizes: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        ends = []
        for doc, n in enumerate(sizes):
            whole = n - n % self.capacity
            for start in range(0, whole, self.capacity):
                yield doc, start, self.capacity, self.sequence, 0
                self.sequence += 1
            if n > whole:
                ends.append((doc, whole, n - whole))
        for pieces in without_short(pack([x[2] for x in ends], self.capacity), self.capacity):
            offset = 0
            for item, start, length in pieces:
                doc, base, _ = ends[item]
                yield doc, base + start, length, self.sequence, offset
                offset += length
            self.sequence += 1


def _packed(path: str | None, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path) if path else Encoder(public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
        packer = Packer(TaskContext.get().partitionId() << 40)
        names = SCHEMA.replace(" long", "").split(", ")

        def done(docs: list, held: list[np.ndarray]) -> pa.RecordBatch:
            rows = []
            for doc, start, length, sequence, offset in packer.shard([len(x) for x in held]):
                part = held[doc][start : start + length]
                rows.append((docs[doc], start, length, zlib.crc32(part.astype("<u4").tobytes()), len(held[doc]), sequence, offset))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        docs, held, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append(doc)
                held.append(np.append(encoder.ids(text), np.uint32(END)))
                size += len(held[-1])
                if size >= shard_tokens:
                    yield done(docs, held)
                    docs, held, size = [], [], 0
        if docs:
            yield done(docs, held)

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``tokenizer`` is the path of a tokenizers file on the executors (None: the public 50k byte BPE).
    """
    texts = text_or_empty(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return texts.mapInArrow(_packed(tokenizer, shard_tokens), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the pieces of all documents."""
    return pack_documents(table(spark, sf_dir, "documents"))
