"""Chunking of texts as Column expressions: overlapping windows, paragraphs, recursive splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import _col


def windows(text, size: int, overlap: int):
    """Array of struct start, text: windows of ``size`` characters, each beginning ``size - overlap`` after the last, until one reaches the end."""
    t, step = _col(text), size - overlap
    if not 0 <= overlap <= step:
        raise ValueError("an overlap of more than half of a window")
    # A window is a block of ``step`` characters and the next one's first ones, so each character is read twice at most.
    blocks = F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    joined = F.transform(F.array(blocks), lambda b: F.transform(b, lambda x, i: F.struct((i * step).alias("start"), F.concat(x, F.coalesce(F.left(F.get(b, i + 1), F.lit(overlap)), F.lit(""))).alias("text"))))[0]
    last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / step)).cast("int")
    found = F.slice(joined, F.lit(1), last + 1)
    return F.when(F.length(t) > 0, found).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def paragraphs(text, most: int):
    """Array of paragraphs, split at blank lines; one of over ``most`` characters is cut every ``most``."""
    found = F.filter(F.transform(F.split(_col(text), r"\n[ \t]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.flatten(F.transform(found, lambda p: F.regexp_extract_all(p, F.lit(rf"(?s).{{1,{most}}}"), F.lit(0))))


def _finer(pieces, most: int, pattern: str):
    """Pieces of over ``most`` characters as the matches of a pattern."""
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > most, F.regexp_extract_all(p, F.lit(pattern), F.lit(0))).otherwise(F.array(p))))


def recursive(text, most: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")):
    """Array of pieces of at most ``most`` characters: a piece that is too long is split behind the next separator of the list, in the end anywhere.

    Joined, the pieces are the text.
    """
    pieces = F.array(_col(text))
    for s in separators:
        pieces = _finer(pieces, most, rf"(?s).*?{s.replace('.', chr(92) + '.')}|.+$")
    pieces = _finer(pieces, most, rf"(?s).{{1,{most}}}")
    return F.filter(pieces, lambda p: p != "")
