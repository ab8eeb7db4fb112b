"""Operator 8: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary enumerates, at each end position of a word, every
piece that ends there, longest first. Dynamic programming over end positions carries the best score
and its number of pieces only; no lattice or segmentation is kept. Tie rules are those of a unigram
tokenizer: pieces are tried by rising start, and only a strictly better score replaces; a character
that no one-character piece covers may be unknown at the lowest score less ``UNKNOWN`` (10), and
neighbouring unknown characters count as one piece.

The states of as many characters as the longest piece has are kept, in rings, so an unbroken text of
any length needs no more memory than itself.

Words are stretches without ASCII white space, each with the vocabulary's word mark in front, so
they are counted once per task, and those of ``SHORT`` bytes at most are kept in a bounded cache. The vocabulary is that of a public
32k-piece file; pieces are scored by rank, -ln(rank + 1), as no public unigram file is installed
and tokenizers are never trained here.

Defined cases: a null or empty text has no words and no tokens; repeated rows are counted again;
doc_id passes through, null or not; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty

MARK, UNKNOWN = "▁", 10.0
VOCABULARY = "piece_bpe_32k.model"
#: Cached words at most, after which the cache starts anew; bytes of a cached word at most.
CACHE, SHORT = 500_000, 64


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores, in the order of the file without its control, byte and unknown pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return [(piece, -math.log(rank + 1.0)) for rank, piece in enumerate(pieces)]


class Counter:
    """Number of pieces, unknown pieces and score of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        #: A state for each place in front of the longest piece, and one for its end.
        self.ring = max(len(p) for p, _ in pieces) + 1
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.cache: dict[str, tuple[int, int, float]] = {}

    def viterbi(self, word: str) -> tuple[int, int, float]:
        """(pieces, unknown among them, best score) of one word."""
        ring = self.ring
        score, count, unknown, is_unknown = [0.0] * ring, [0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(word)
        match = next(matches, None)
        at = 0
        for end in range(len(word)):
            best = None
            single = False
            while match is not None and match[0] == end:
                length, s = match[1]
                start = (end + 1 - length) % ring
                single = single or length == 1
                x = score[start] + s
                if best is None or x > best:
                    best, origin, by_piece = x, start, True
                match = next(matches, None)
            if not single:
                x = score[at] + self.unknown
                if best is None or x > best:
                    best, origin, by_piece = x, at, False
            at = (end + 1) % ring
            new = not by_piece and not is_unknown[origin]
            score[at], count[at], unknown[at], is_unknown[at] = best, count[origin] + (by_piece or new), unknown[origin] + new, not by_piece
        return count[at], unknown[at], score[at]

    def of(self, text: str) -> tuple[int, int, int, float]:
        """(words, pieces, unknown pieces, score) of one text."""
        words = text.encode("utf-8", "surrogatepass").split()
        found = list(map(self.cache.get, words))
        if None in found:
            new = {w for w, x in zip(words, found, strict=True) if x is None}
            made = {w: self.viterbi(MARK + w.decode("utf-8", "surrogatepass")) for w in new}
            found = [made[w] if x is None else x for w, x in zip(words, found, strict=True)]
            made = {w: x for w, x in made.items() if len(w) <= SHORT}
            if len(self.cache) + len(made) > CACHE:
                self.cache.clear()
            self.cache |= made
        return len(words), sum(x[0] for x in found), sum(x[1] for x in found), math.fsum(x[2] for x in found)


def _counts(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path))
        for batch in batches:
            rows = list(zip(*map(counter.of, batch.column("text").to_pylist()), strict=True)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]], ["doc_id", "n_words", "n_tokens", "n_unknown", "score"])

    return run


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown and score of every row; ``path`` is a vocabulary file."""
    texts = text_or_empty(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return texts.mapInArrow(_counts(path), "doc_id long, n_words long, n_tokens long, n_unknown long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: token counts of all documents."""
    return token_counts(table(spark, sf_dir, "documents"))
