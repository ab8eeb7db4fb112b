"""Operator 9: substring dedup by matching statistics against suffix automata of reference shards.

A window is ``WINDOW`` (50) consecutive words of one document. A word goes when a window that
covers it also starts in a document with a smaller ``doc_id``.

How it runs. Each window picks the smallest hash among its eight-word grams as its anchor, so equal
windows pick equal anchors; consecutive windows with the same anchor position form a run of at
most 43 windows. One pass over the texts writes the runs (no text, some 40 bytes each). Runs of equal
content (anchor and a 128-bit hash of their words) are grouped; only the first holder can owe its
words to something else, every later holder loses all of the run's windows. Of runs that share an
anchor but not their whole content, the texts and the hashes of their windows are cut out of the
documents. A window's two hashes say which runs may hold what an earlier document's run holds (equal
windows have equal hashes, so none is missed), and words decide: those earlier runs are the reference
shards, each a suffix automaton of about ``SHARD_WORDS`` words, and the runs that may owe them words
are streamed along for their matching statistics. Each state knows the smallest document it occurs
in, so the longest match with a smaller document decides. A shard's automaton goes to the runs that
may match it; all automata of a growing corpus would not fit a broadcast. A reference that more
than ``CLAIMS`` runs may owe is copied to as many groups as they fill, so no group is unbounded.

Defined cases: a null text is the empty text; texts under 50 words keep all words; repeats inside
one document stay; rows that share a ``doc_id`` never take words from each other, whether their texts
are equal or not; equal rows are looked at once, so many of them cost no more than being read; a row with a
null ``doc_id`` neither loses words nor takes them from others; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, same, table

WINDOW, GRAM = 50, 8
#: Words in one reference shard, after which the next anchor starts another.
SHARD_WORDS = 40_000
#: Runs that one copy of a reference run meets.
CLAIMS = 200
_RUN = WINDOW - GRAM + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Hashes:
    """64-bit hashes of all word ranges of one text; another ``base`` gives independent ones."""

    def __init__(self, each: np.ndarray, base: np.uint64 = _BASE):
        n = len(each)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(each * _powers(base, n), dtype=np.uint64)]
        self.back = _powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def runs_of(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """start, number of windows, anchor and the two content hashes of each run of a text."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 5
    each = word_hashes(words)
    hashes = Hashes(each)
    at = np.arange(n + _RUN - 1)
    grams = hashes.of(at, at + GRAM)
    # The leftmost smallest gram of each window, by doubling.
    low, width = at.copy(), 1
    while width < _RUN:
        step = min(width, _RUN - width)
        a, b = low[: len(low) - step], low[step:]
        low = np.where(grams[b] < grams[a], b, a)
        width += step
    first = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
    count = np.diff(np.r_[first, n])
    end = first + count + WINDOW - 1
    other = Hashes(each ^ (each >> np.uint64(31)), _OTHER).of(first, end)
    return first, count, grams[low[first]].view(np.int64), hashes.of(first, end).view(np.int64), other.view(np.int64)


RUNS = "doc_id long, part long, start int, n int, anchor long, content long, other long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RUNS.split(", ")]
    for batch in batches:
        held: list[tuple] = []
        size = 0
        for doc, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text")), strict=True):
            start, count, *keys = runs_of(words_of(text))
            if len(start):
                held.append((np.full(len(start), doc), np.full(len(start), part), start.astype(np.int32), count.astype(np.int32), *keys))
                size += len(start)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)


PIECES = "anchor long, content long, other long, doc_id long, windows array<long>, seconds array<int>, words binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted run and the two hashes of each of its windows."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in PIECES.split(", ")])

    for batch in batches:
        out: list[tuple] = []
        for doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "wanted")), strict=True):
            words = words_of(text)
            each = word_hashes(words)
            hashes, others = Hashes(each), Hashes(each ^ (each >> np.uint64(31)), _OTHER)
            for x in wanted:
                s, n = x["start"], x["n"]
                at = np.arange(s, s + n)
                out.append((x["anchor"], x["content"], x["other"], doc, hashes.of(at, at + WINDOW).view(np.int64), others.of(at, at + WINDOW).view(np.int64).astype(np.int32), b" ".join(words[s : s + n + WINDOW - 1])))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)


class SuffixAutomaton:
    """A suffix automaton of word sequences; each state knows the smallest document it occurs in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, moves: dict, link: int, length: int, first) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def add(self, words: list, doc: int) -> None:
        """Add one sequence; it starts anew at the root, so no match runs over its ends."""
        moves, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            known = moves[last].get(w)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self._split(last, w, known)
            else:
                new = self._state({}, 0, length[last] + 1, None)
                p = last
                while p != -1 and w not in moves[p]:
                    moves[p][w] = new
                    p = link[p]
                if p != -1:
                    q = moves[p][w]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = new
            if self.first[last] is None or doc < self.first[last]:
                self.first[last] = doc

    def _split(self, p: int, w, q: int) -> int:
        moves, link = self.next, self.link
        clone = self._state(dict(moves[q]), link[q], self.length[p] + 1, None)
        while p != -1 and moves[p].get(w) == q:
            moves[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def settle(self) -> None:
        """Pass each state's smallest document on to its suffixes."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up, doc = self.link[v], self.first[v]
            if up > 0 and doc is not None and (self.first[up] is None or doc < self.first[up]):
                self.first[up] = doc

    def ends(self, words: list, doc: int, least: int) -> Iterator[int]:
        """Positions in ``words`` where a match of ``least`` words with a smaller document ends."""
        moves, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        for i, w in enumerate(words):
            while state and w not in moves[state]:
                state = link[state]
                size = length[state]
            if w in moves[state]:
                state = moves[state][w]
                size += 1
            v, long = state, size
            while long >= least and first[v] >= doc:
                v = link[v]
                long = length[v]
            if long >= least:
                yield i


def _shard_masks(references: list[tuple], claims: list[tuple]) -> list[tuple]:
    """(anchor, content, other, mask): bit i says that window i of the run is in a smaller document's reference run."""
    ids: dict[bytes, int] = {}
    automaton = SuffixAutomaton()
    for *_, doc, words in references:
        automaton.add([ids.setdefault(w, len(ids)) for w in words.split(b" ")], doc)
    automaton.settle()
    out = []
    for anchor, content, other, doc, words in claims:
        if mask := sum(1 << (i - WINDOW + 1) for i in automaton.ends([ids.get(w, -1) for w in words.split(b" ")], doc, WINDOW)):
            out.append((anchor, content, other, mask))
    return out


MASKS = "anchor long, content long, other long, mask long"


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by reference run (``shard``); one automaton takes in several."""

    def done() -> Iterator[pa.RecordBatch]:
        if found := _shard_masks(references, claims):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], [x.split(" ")[0] for x in MASKS.split(", ")])

    references, claims, size, last = [], [], 0, None
    for batch in batches:
        for shard, *row, claim in zip(*(batch.column(c).to_pylist() for c in ("shard", "anchor", "content", "other", "doc_id", "words", "claim")), strict=True):
            if shard != last and size > SHARD_WORDS:
                yield from done()
                references, claims, size = [], [], 0
            last = shard
            (claims if claim else references).append(row)
            size += len(row[4]) // 6
    yield from done()


def removals(texts: DataFrame, claims: int = CLAIMS) -> DataFrame:
    """doc_id, part and removed: array of (start, mask, n), the repeated windows of each run.

    ``texts`` has doc_id, part (which tells the texts of one doc_id apart) and text, each pair of them once.
    """
    texts = texts.where("doc_id is not null")
    runs = cut(texts.mapInArrow(_runs, RUNS))
    key = ["anchor", "content", "other"]
    contents = cut(runs.groupBy(*key).agg(F.min(F.struct("doc_id", "part", "start", "n")).alias("first"), F.max("doc_id").alias("last")))
    several = contents.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1")
    wanted = contents.join(several, "anchor").groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.part").alias("part")).agg(F.collect_list(F.struct(*key, "first.start", "first.n")).alias("wanted"))
    pieces = cut(texts.join(wanted, ["doc_id", "part"]).select("doc_id", "text", "wanted").mapInArrow(_cut_out, PIECES))
    # Equal windows have equal hashes, of 96 bits together: what an earlier run holds, and which run that is. A run goes by
    # its content hash here; should two runs share one, both are looked at, as words decide.
    windows = pieces.select(F.explode(F.arrays_zip("windows", "seconds")).alias("w"), "doc_id", "content").select("w.*", "doc_id", "content")
    window = ["windows", "seconds"]
    origin = windows.groupBy(*window).agg(F.min(F.struct("doc_id", "content")).alias("o"), F.max("doc_id").alias("last")).where("last > o.doc_id").select(*window, F.col("o.doc_id").alias("origin"), F.col("o.content").alias("shard"))
    owing = cut(windows.join(origin, window).where("doc_id > origin").select("content", "shard").distinct())
    references = owing.groupBy("shard").agg(F.ceil(F.count("*") / claims).cast("int").alias("groups"))
    copies = references.select("shard", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("shard").alias("content"), F.lit(False).alias("claim"))
    asking = owing.join(references, "shard").select("shard", F.pmod(F.xxhash64("content"), "groups").cast("int").alias("group"), "content", F.lit(True).alias("claim"))
    shards = copies.union(asking).join(pieces.drop(*window), "content")
    masks = shards.repartition("shard", "group").sortWithinPartitions("shard", "group", "claim").mapInArrow(_masks, MASKS).groupBy(*key).agg(F.bit_or("mask").alias("mask"))
    # A table of its own, so that the join with the runs can split a run that very many documents hold.
    guilty = cut(contents.join(masks, key, "left").where("last > first.doc_id or mask is not null").select(*key, F.col("first.doc_id").alias("origin"), F.coalesce("mask", F.lit(0)).alias("mask")))
    # All windows of the run go when a smaller document holds the same run.
    found = runs.join(guilty, key).where("doc_id > origin or mask <> 0")
    return found.groupBy("doc_id", "part").agg(F.collect_list(F.struct("start", F.when(F.col("doc_id") > F.col("origin"), F.lit(-1)).otherwise(F.col("mask")).alias("mask"), "n")).alias("removed"))


def kept_words(words: list[bytes], removed: list[dict] | None) -> list[bytes]:
    """The words that no repeated window covers."""
    if not removed:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for x in removed:
        for i in range(x["n"]):
            if x["mask"] >> i & 1:
                edge[x["start"] + i] += 1
                edge[x["start"] + i + WINDOW] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, left, texts = [], [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            words = words_of(text)
            kept = kept_words(words, removed)
            total.append(len(words))
            left.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(left, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows as doc_id, part and text, and each different (doc_id, text) once; ``part`` tells the texts of one doc_id apart.

    ``part`` is a hash of 31 bits, as runs carry it. That no two texts of a doc_id share it is counted; where
    two do, hashes of 64 bits are taken, of another seed until no two are equal. Texts move only where rows are repeated.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    known = rows.where("doc_id is not null")
    keys = cut(known.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")).groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")))
    short = F.col("h1").bitwiseAND(F.lit((1 << 31) - 1))
    clash, seed = keys.groupBy("doc_id", short).agg(F.count("*").alias("n")).where("n > 1"), 0
    while not clash.isEmpty():
        seed += 1
        parts = known.select("doc_id", F.xxhash64(F.lit(seed), "text").alias("part"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")).distinct()
        clash = parts.groupBy("doc_id", "part").agg(F.count("*").alias("n")).where("n > 1")
    part = F.xxhash64(F.lit(seed), "text") if seed else F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1))
    rows, known = (x.select("doc_id", part.alias("part"), "text") for x in (rows, known))
    repeated = keys.where("n > 1")
    if repeated.isEmpty():
        return rows, known
    few = repeated.select(F.col("doc_id").alias("_doc"), "h1", "h2")
    same_row = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("h1")) & (F.xxhash64(F.lit("second"), "text") == F.col("h2"))
    return rows, known.join(few, same_row, "left_anti").unionByName(known.join(few, same_row, "left_semi").dropDuplicates(["doc_id", "part"]))


def _with_removals(docs: DataFrame, claims: int = CLAIMS) -> DataFrame:
    rows, texts = _told_apart(docs)
    found = removals(texts, claims).toDF("_doc", "_part", "removed")
    return rows.join(found, same(F.col("doc_id"), F.col("_doc")) & (F.col("part") == F.col("_part")), "left").select("doc_id", "text", "removed")


def without_repeats(docs: DataFrame, claims: int = CLAIMS) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the remaining words joined by spaces."""
    return _with_removals(docs, claims).mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: doc_id, n_words, n_removed and kept_sha256 of all documents."""
    docs = table(spark, sf_dir, "documents")
    return _with_removals(docs).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int, str]]:
    """The result by definition, for tests on small tables."""
    first: dict[tuple, int] = {}
    split = [(doc, words_of(text)) for doc, text in rows]
    for doc, words in split:
        if doc is not None:
            for i in range(len(words) - WINDOW + 1):
                key = tuple(words[i : i + WINDOW])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in split:
        gone = [False] * len(words)
        if doc is not None:
            for i in range(len(words) - WINDOW + 1):
                if first[tuple(words[i : i + WINDOW])] < doc:
                    gone[i : i + WINDOW] = repeat(True, WINDOW)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
