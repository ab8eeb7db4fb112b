"""Word segmentation of scripts without blanks, by the best path through a dictionary's words.

A run of the script's characters is cut into dictionary words and single characters so that the sum of their
weights is largest: a word weighs the logarithm of its share of all occurrences, a character that is no
word that of half an occurrence. Of equal cuts the one of fewer pieces wins, then the one whose first pieces are longer.
What is not of the script is cut into the usual Latin tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of Han characters, and Latin tokens.
HAN = "[一-鿿]+"
LATIN = r"[a-z0-9][a-z0-9+._#-]*"
#: Words that a dictionary may have, as all of it goes to every task.
WORDS = 500_000
#: Runs whose cuts a task remembers, and characters of the longest such run.
RUNS, SHORT_RUN = 200_000, 64


def weights(words: dict[str, int]) -> tuple[dict[str, float], float]:
    """The weight of each word and of a character that is none."""
    total = sum(words.values()) + 0.5
    return {w: math.log(n / total) for w, n in words.items() if w and n > 0}, math.log(0.5 / total)


def cut(run: str, weight: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The best cut of a run, from its end to its start: each place keeps the best cut of what follows."""
    n = len(run)
    # (weight rounded, so that sums of equal words in other orders are equal; pieces; minus length) of the best cut from a place on.
    best: list[tuple[float, int]] = [(0.0, 0)] * (n + 1)
    step = [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        found = None
        for size in range(1, min(longest, n - i) + 1):
            word = run[i : i + size]
            own = weight.get(word, unknown if size == 1 else None)
            if own is None:
                continue
            after = best[i + size]
            value = (round(own + after[0], 9), -(after[1] + 1), size)
            if found is None or value > found:
                found = value
        best[i], step[i] = (found[0], -found[1]), found[2]
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def cutter(weight: dict[str, float], unknown: float, longest: int) -> Callable[[str], list[str]]:
    """``cut`` that remembers the cuts of short runs, which texts repeat more often than not."""
    known: dict[str, list[str]] = {}

    def pieces(run: str) -> list[str]:
        if len(run) > SHORT_RUN:
            return cut(run, weight, unknown, longest)
        if (made := known.get(run)) is None:
            if len(known) >= RUNS:
                known.clear()
            known[run] = made = cut(run, weight, unknown, longest)
        return made

    return pieces


def segmented(docs: DataFrame, dictionary: DataFrame, script: str = HAN) -> DataFrame:
    """doc_id and tokens of each ``text``, in lower case and in order; ``dictionary`` has word and n (how often it occurs)."""
    rows = dictionary.where("word is not null and n > 0").groupBy("word").agg(F.sum("n").alias("n")).limit(WORDS + 1).collect()
    if len(rows) > WORDS:
        raise ValueError(f"the dictionary has more than {WORDS} words")
    weight, unknown = weights({r.word: r.n for r in rows})
    longest = max(map(len, weight), default=1)
    pattern = f"(?P<run>{script})|{LATIN}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pieces = re.compile(pattern), cutter(weight, unknown, longest)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                own: list[str] = []
                for m in found.finditer((text or "").lower()):
                    own += pieces(m[0]) if m["run"] else [m[0]]
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.string()))], ["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens array<string>")
