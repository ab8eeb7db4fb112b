"""The smallest stretch of a text that holds all of several anchors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def places(text: str, anchor: str) -> list[int]:
    """All places at which an anchor starts, overlapping ones too."""
    found, at = [], text.find(anchor) if anchor else -1
    while at >= 0:
        found.append(at)
        at = text.find(anchor, at + 1)
    return found


def smallest(text: str, anchors: list[str]) -> tuple[int, int] | None:
    """Start and end of the shortest stretch that holds each anchor, the leftmost of several; None where one is missing.

    Places of all anchors are merged in order; the window's left end moves on while every anchor is still in it.
    """
    wanted = sorted(set(anchors))
    hits = sorted((at, i) for i, a in enumerate(wanted) for at in places(text, a))
    last: dict[int, int] = {}
    best = None
    for at, i in hits:
        last[i] = at
        if len(last) == len(wanted):
            start, end = min(last.values()), max(p + len(wanted[k]) for k, p in last.items())
            if best is None or end - start < best[1] - best[0]:
                best = start, end
    return best


def windows(pairs: DataFrame, key: str = "qid", doc: str = "doc_id") -> DataFrame:
    """key, doc, start and end of the smallest window of each row (key, doc, text, anchors) that holds all of its anchors; others are left out."""
    kinds = f"{key} long, {doc} long, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, d, text, anchors in zip(*(batch.column(c).to_pylist() for c in (key, doc, "text", "anchors")), strict=True):
                if text is not None and anchors and (w := smallest(text, [a for a in anchors if a])):
                    rows.append((k, d, *w))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], [key, doc, "start", "end"])

    return pairs.select(key, doc, "text", "anchors").mapInArrow(run, kinds)
