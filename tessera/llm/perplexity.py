"""Operator 5: quality rules with a modified Kneser-Ney n-gram model and perplexity bands.

Base rules fail a document of under ``MIN_WORDS`` words, or one in which more than a fifth of the
words lie in five-word windows found twice or more. The method then rejects documents whose
perplexity leaves the band of their language, above or below.

Model: interpolated modified Kneser-Ney over n-grams of ``ORDER`` (5) code points of any script. A
text must not vouch for itself or its copies, so an n-gram counts only if two different texts have
it (the usual pruning of singletons); the others get the probability that their context backs off to.

How it runs: tasks count n-grams, Spark adds the counts up and derives the discounts (D1, D2, D3+ by
order, from counts of counts) and every n-gram's probability with aggregations and shuffled joins.
The table grows with the corpus and is never broadcast whole: its most frequent n-grams, ``HOT`` at
most whatever the corpus, travel to the tasks as sorted hash arrays with an index of their first bits,
and a text's other n-grams are written as (row, n-gram, times) and joined to the table. Both ways give
an n-gram the same probability; hot ones never become rows, so no key of that join is hot. One pass
over the texts yields the rules' figures and the sums, another has counted.
Each language's band reaches to ``ABOVE`` standard deviations over its median entropy, from a
histogram of entropies per language in steps of 0.01 (each side by its quartile, so junk hardly moves it and
skew is kept), wider for short texts by the variance that their length explains. Below, documents depend less
on chance than that: how deep they lie, in the same units, is counted once more, and ``BELOW``
deviations by the lower quartile of these depths are the lower band, so templates and boilerplate fall.

Defined cases: a null text is the empty text, has no words and fails; a null language is one of its
own; a language of one document keeps it (its own median); repeated rows are judged alike; doc_id
passes through, null or not; ``passing`` decides by text and language, never by doc_id; a very long
text is read in stretches; further columns are ignored (kept by ``passing``); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, same, table, text_or_empty

ORDER = 5
MIN_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20
#: Standard deviations below and above a language's median entropy; entropies are counted by 1/STEP.
BELOW, ABOVE, STEP = 4.0, 2.5, 100
#: Characters and texts that one array holds while n-grams are counted or scored.
CHUNK, TEXTS = 250_000, 4096
#: N-grams that a task holds before it adds up equal ones; n-grams that are sent to all tasks at most.
HELD, HOT = 1_000_000, 1_000_000
#: Frequencies are told apart by 1/FINE of a power of two; first bits of a hash that the index knows.
FINE, INDEX_BITS = 16, 20
SYMBOLS = b"#*$%&|<>"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _stretches(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, stretch with the ``ORDER`` - 1 characters before it), in lists of about ``CHUNK`` characters.

    A text begins after ``ORDER`` - 1 line ends.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        t = "\n" * (ORDER - 1) + t
        for at in range(0, max(1, len(t) - ORDER + 1), CHUNK):
            held.append((i, t[at : at + CHUNK + ORDER - 1]))
            size += len(held[-1][1])
            if size > CHUNK or len(held) == TEXTS:
                yield held
                held, size = [], 0
    if held:
        yield held


def hashes_of(code: np.ndarray) -> np.ndarray:
    """64-bit hash of the n-gram at each place of the code points."""
    n = max(0, len(code) - ORDER + 1)
    h = np.zeros(n, np.uint64)
    for i in range(ORDER):
        h *= _BASE
        h += code[i : n + i]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def grams_of(stretches: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all stretches, and place, hash and text of each n-gram: one per character."""
    code = np.frombuffer("".join([t for _, t in stretches]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(t) - ORDER + 1 for _, t in stretches), np.int64, len(stretches))
    at = np.arange(sizes.sum()) + np.repeat((ORDER - 1) * np.arange(len(sizes)), sizes)
    return code, at, hashes_of(code)[at], np.repeat(np.fromiter((i for i, _ in stretches), np.int64, len(stretches)), sizes)


def _spelled(codes: np.ndarray) -> pa.Array:
    """N-grams as strings."""
    whole = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([whole[i : i + ORDER] for i in range(0, len(whole), ORDER)], pa.string())


def _added_up(parts: list[tuple]) -> tuple:
    """hash, code points, n and text of different n-grams; text 0 says that several texts have it."""
    h, codes, n, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    low, high = np.minimum.reduceat(text[order], starts), np.maximum.reduceat(text[order], starts)
    first = order[starts]
    return h[first], codes[first], np.add.reduceat(n[order], starts), np.where(low == high, low, 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done() -> pa.RecordBatch:
        _, codes, n, text = held[0]
        return pa.RecordBatch.from_arrays([_spelled(codes), pa.array(n), pa.array(text.astype(np.int32))], ["gram", "n", "text"])

    held: list[tuple] = []
    for batch in batches:
        # Copies of a text share a number, and no number is 0.
        own = (batch.column("text_hash").to_numpy() & 0x7FFFFFFF) | 1
        for stretches in _stretches(batch.column("text").to_pylist()):
            code, at, h, doc = grams_of(stretches)
            if not len(h):
                continue
            text = own[doc]
            # By n-gram and text; equal n-grams that a foreign one parts are added up later.
            order = np.argsort((h & ~np.uint64(0xFFF)) | np.unique(text, return_inverse=True)[1].astype(np.uint64))
            h, text = h[order], text[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            ends = np.r_[starts[1:], len(h)]
            codes = code[at[order[starts]][:, None] + np.arange(ORDER)]
            held.append((h[starts], codes, ends - starts, np.where(text[starts] == text[ends - 1], text[starts], 0)))
            if sum(len(x[0]) for x in held) > HELD:
                held = [_added_up(held)]
                if len(held[0][0]) > HELD // 2:
                    yield done()
                    held = []
    if held:
        held = [_added_up(held)]
        yield done()


def n_gram_counts(texts: DataFrame) -> DataFrame:
    """gram, seen (how often) and n (the same, or 0 where one text alone has it) of all n-grams of the column ``text``."""
    found = texts.select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(_counted, "gram string, n long, text int")
    return found.groupBy("gram").agg(F.sum("n").alias("seen"), F.when((F.min("text") == 0) | (F.min("text") < F.max("text")), F.sum("n")).otherwise(F.lit(0)).cast("long").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of n-grams seen once, twice and more often, from four counts of counts.

    Where counts of counts leave a discount undefined, it is 0.5, 1 and 1.5.
    """
    seen = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    n1, n2, n3, n4 = counts.agg(*seen).first()
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(d if 0 < d <= i else i / 2 for i, d in enumerate(found, 1))


def model(counts: DataFrame) -> DataFrame:
    """gram, seen and p (its interpolated probability) of all n-grams of ``counts`` (gram, seen, n).

    Shorter n-grams count how many characters stand before them. The shortest one is interpolated
    with an even share of all characters found.
    """
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = cut(tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n")))
    characters = max(1, tables[1].count())
    lower = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[k])
        d = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = Window.partitionBy("context")
        total = F.sum("n").over(context)
        rows = tables[k].withColumn("context", F.substring("gram", 1, k - 1))
        # A context of which no n-gram counts passes everything on.
        own, rest = F.when(total > 0, (F.col("n") - d) / total).otherwise(0.0), F.when(total > 0, F.sum(d).over(context) / total).otherwise(1.0)
        rows = rows.select(*tables[k].columns, own.alias("own"), rest.alias("rest"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / characters))
        else:
            rows = rows.join(lower, F.substring("gram", 2, k - 1) == F.col("shorter"))
        rows = rows.withColumn("p", F.col("own") + F.col("rest") * F.col("below"))
        lower = rows.select(F.col("gram").alias("shorter"), F.col("p").alias("below"))
    return rows.select("gram", "seen", "p")


def _frequency(seen):
    """Class of a frequency, rising with it."""
    return F.floor(F.log2(seen) * FINE)


def hot_from(grams: DataFrame, hot: int = HOT) -> int:
    """The lowest class of frequency from which on there are at most ``hot`` n-grams."""
    classes = grams.groupBy(_frequency(F.col("seen")).alias("at")).count().orderBy(F.desc("at")).collect()  # 64 * FINE at most
    total, lowest = 0, 64 * FINE
    for r in classes:
        total += r["count"]
        if total > hot:
            break
        lowest = r["at"]
    return lowest


class Hot:
    """Log probabilities of the most frequent n-grams in sorted hash arrays."""

    def __init__(self, rows: pa.Table):
        code = np.frombuffer("".join(rows.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        keys = hashes_of(code)[::ORDER]
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], rows.column("log").to_numpy()[order]
        self.index = np.searchsorted(self.keys >> np.uint64(64 - INDEX_BITS), np.arange(2**INDEX_BITS + 1)).astype(np.int32)

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities, 0 where an n-gram is not here, and whether it is."""
        first = (wanted >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        at, end = self.index[first], self.index[first + 1]
        log, known = np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            place = at[open_]
            hit = self.keys[place] == wanted[open_]
            log[open_[hit]], known[open_[hit]] = self.logs[place[hit]], True
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return log, known


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of ``WINDOW`` words that are found twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    keys = hashes[:n].copy()
    for i in range(1, WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i]
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys)
    ranked = keys[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return len(words), len(text) - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(hashes)


SCORED = (
    "id long, key long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n long, log_sum double, square_sum double, gram string, k long"
)
_NAMES = [x.split(" ")[0] for x in SCORED.split(", ")]


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        number = TaskContext.get().partitionId() << 40
        longs = [pa.int64()] * 5
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = np.arange(number, number + len(texts))
            number += len(texts)
            n, s, q = (np.zeros(len(texts)) for _ in range(3))
            for stretches in _stretches(texts):
                code, at, h, doc = grams_of(stretches)
                log, known = hot.of(h)
                n += np.bincount(doc, minlength=len(texts))
                s += np.bincount(doc, log, len(texts))
                q += np.bincount(doc, log * log, len(texts))
                cold = np.flatnonzero(~known)
                if not len(cold):
                    continue
                order = cold[np.lexsort((h[cold], doc[cold]))]
                starts = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
                first = order[starts]
                columns = dict.fromkeys(_NAMES) | {"id": pa.array(ids[doc[first]]), "gram": _spelled(code[at[first][:, None] + np.arange(ORDER)]), "k": pa.array(np.diff(np.r_[starts, len(order)]))}
                yield _rows(columns, len(first))
            figures = list(zip(*map(statistics, texts), strict=True)) or [()] * 5
            columns = dict.fromkeys(_NAMES) | {c: batch.column(c) for c in ("key", "doc_id", "lang")} | {"id": pa.array(ids), "n": pa.array(n.astype(np.int64)), "log_sum": pa.array(s), "square_sum": pa.array(q)}
            columns |= {c: pa.array(x, kind) for c, x, kind in zip(_NAMES[4:9], figures, longs, strict=True)}
            yield _rows(columns, len(texts))

    return run


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _rows(columns: dict, n: int) -> pa.RecordBatch:
    """A batch of ``SCORED`` in which columns without values are null."""
    kinds = [_KINDS[x.split(" ")[1]] for x in SCORED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if x is None else x for x, kind in zip(columns.values(), kinds, strict=True)], _NAMES)


def scores(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """The rules' figures of each row of ``texts``, n (its n-grams), and the sums of their log probabilities and of the squares."""
    grams = cut(model(cut(n_gram_counts(texts))).select("gram", "seen", F.log("p").alias("log")))
    lowest = hot_from(grams, hot)
    shared = texts.sparkSession.sparkContext.broadcast(Hot(grams.where(_frequency(F.col("seen")) >= lowest).select("gram", "log").toArrow()))
    found = cut(texts.mapInArrow(_scored(shared), SCORED))
    cold = found.where("gram is not null").select("id", "gram", "k").join(grams.where(_frequency(F.col("seen")) < lowest).select("gram", "log"), "gram")
    cold = cold.groupBy(F.col("id").alias("_id")).agg(F.sum(F.col("k") * F.col("log")).alias("_s"), F.sum(F.col("k") * F.col("log") * F.col("log")).alias("_q"))
    rows = found.where("gram is null").drop("gram", "k").join(cold, F.col("id") == F.col("_id"), "left")
    return rows.withColumns({"log_sum": F.col("log_sum") + F.coalesce("_s", F.lit(0.0)), "square_sum": F.col("square_sum") + F.coalesce("_q", F.lit(0.0))}).drop("id", "_id", "_s", "_q")


def verdict_key(text, lang):
    """Hash of what a verdict rests on: the text (null is empty) and the language (null is its own)."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), lang.isNull(), lang.cast("string"))


def _quartiles(binned: DataFrame, *aggregates) -> DataFrame:
    """lang and low, middle, high: the middles of the bins that hold the quartiles, of (lang, bin, docs) rows; and further aggregates."""
    order = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.select("*", F.sum("docs").over(order).alias("upto"), F.sum("docs").over(Window.partitionBy("lang")).alias("total"))

    def at(share: float):
        return F.min(F.when(F.col("upto") >= F.col("total") * share, (F.col("bin") + 0.5) / STEP))

    return ranked.groupBy("lang").agg(at(0.25).alias("low"), at(0.5).alias("middle"), at(0.75).alias("high"), *aggregates)


def bands(scored: DataFrame) -> DataFrame:
    """lang, middle, spread_below, spread_above and noise: each language's median entropy, its standard deviation by the quartile on either side and the variance of one character."""
    judged = scored.where("not base_failed")
    bins = judged.groupBy("lang", F.floor(F.col("entropy") * STEP).alias("bin")).agg(
        F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("log_sum").alias("s"), F.sum("square_sum").alias("q")
    )
    found = _quartiles(bins, (F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("noise"))
    return found.select(
        "lang", "middle", (2 * (F.col("middle") - F.col("low")) / 1.349 + 1.0 / STEP).alias("spread_below"), (2 * (F.col("high") - F.col("middle")) / 1.349 + 1.0 / STEP).alias("spread_above"), "noise"
    )


def judge(docs: DataFrame, below: float = BELOW, above: float = ABOVE, hot: int = HOT) -> DataFrame:
    """All figures, base_failed, perplexity, lower and upper (the document's band) and kept of every row."""
    key = verdict_key(F.col("text"), F.col("lang")).alias("key")
    texts = text_or_empty(docs, key, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    entropy = F.when(F.col("n") > 0, -F.col("log_sum") / F.col("n")).otherwise(0.0)
    scored = cut(scores(texts, hot).withColumns({"base_failed": failed, "entropy": entropy}))
    judged = scored.join(bands(scored).withColumnRenamed("lang", "_lang"), same(F.col("lang"), F.col("_lang")), "left").drop("_lang")
    under, over = (F.sqrt(F.pow(f"spread_{side}", 2) + F.col("noise") / F.greatest(F.col("n"), F.lit(1))) for side in ("below", "above"))
    judged = judged.withColumns({"under": under, "z": (F.col("entropy") - F.col("middle")) / under})
    # How far documents of a language really lie under its median, in units of what spread and length make likely.
    depths = _quartiles(judged.where("not base_failed").groupBy("lang", F.floor(F.col("z") * STEP).alias("bin")).agg(F.count("*").alias("docs")))
    depths = depths.select(F.col("lang").alias("_lang"), (F.col("middle") - F.lit(float(below)) * (2 * (F.col("middle") - F.col("low")) / 1.349 + 1.0 / STEP)).alias("deepest"))
    judged = judged.join(depths, same(F.col("lang"), F.col("_lang")), "left").drop("_lang")
    judged = judged.withColumns({"perplexity": F.exp("entropy"), "lower": F.exp(F.col("middle") + F.col("deepest") * F.col("under")), "upper": F.exp(F.col("middle") + F.lit(float(above)) * over)})
    kept = ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return judged.withColumn("kept", kept)


def passing(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The rows of ``docs`` that neither a base rule nor a band rejects."""
    name = fresh(docs, "_dropped")
    dropped = judge(docs, below, above).where("not kept").select(F.col("key").alias(name)).distinct()
    return docs.join(dropped, verdict_key(docs["text"], docs["lang"]) == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: figures, base_failed, kept, perplexity and band of all documents."""
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower", "upper")
