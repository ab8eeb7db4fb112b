import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm.helpers import ODD, documents, prose


def _ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def _check(rows, found):
    """Pieces tile each document and each sequence; ids are those of the tokenizer."""
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = _ids(texts[doc][0])
        assert sum(p.length for p in pieces) == len(ids) * len(texts[doc])
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
        if len(texts[doc]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.length > 0
                at += p.length
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


HARD = ["  two  blanks\n\n\nlines  \t tab x", "it's don't I'LL 12345 x1y2", "<|endoftext|> in a text", "\r\n mixed   é́ \U0001f600 中文", " ", "\n", "a" * 3000]


def test_pieces_tile_documents(spark, sf_dir):
    rows = ODD + [(100 + i, t, "en", "a", 0) for i, t in enumerate(HARD)]
    rows += [(1000 + r.doc_id, r.text, r.lang, r.source, 0) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = packing.pack_documents(documents(spark, rows, extra=True)).collect()
    assert _check(rows, found) <= 1.25 * packing.SLACK * sum(r.length for r in found)
    assert packing.pack_documents(documents(spark, [])).count() == 0


def _concatenated(lengths, capacity=1024):
    """Pieces of each sequence when all items stand in one row and are cut every ``capacity``."""
    sequences, room = [[]], capacity
    for n in lengths:
        while n:
            take = min(n, room)
            sequences[-1].append(take)
            n, room = n - take, room - take
            if not room:
                sequences.append([])
                room = capacity
    return [s for s in sequences if s]


def _spread(sequences):
    costs = [sum(packing.cost(x) for x in s) for s in sequences]
    return np.std(costs) / np.mean(costs)


def _first_fit(lengths, capacity=1024):
    """Whole items, longest first, each in the first sequence with room: no regard for cost."""
    sequences, room = [], []
    for n in sorted(lengths, reverse=True):
        i = next((i for i, r in enumerate(room) if r >= n), len(room))
        if i == len(room):
            sequences.append([])
            room.append(capacity)
        sequences[i].append(n)
        room[i] -= n
    return sequences


#: Cuts at most, as a part of those of one long row; spread of cost at most, as a part of first fit's and of one long row's.
BOUNDS = {"uniform": (0.01, 1.01, 1.05), "small": (0.01, 0.5, 0.5), "long-tailed": (0.01, 0.95, 1.4), "pairs do not fit": (0.6, 1.0, 1.0)}
LENGTHS = {
    "uniform": lambda rng: rng.integers(1, 1024, 2000),
    "small": lambda rng: rng.integers(1, 300, 4000),
    "long-tailed": lambda rng: np.clip(rng.lognormal(5, 1, 4000), 1, 1023).astype(int),
    "pairs do not fit": lambda rng: rng.integers(600, 1023, 1300),
}


@pytest.mark.parametrize("kind", LENGTHS)
def test_packing_cuts_little_and_balances(kind):
    """Documents stay whole and costs even, against cutting one long row of documents."""
    lengths = LENGTHS[kind](np.random.default_rng(1)).tolist()
    sequences = packing.pack(lengths)
    held = np.zeros(len(lengths), int)
    for s in sequences:
        assert sum(p[2] for p in s) <= 1024
        for item, start, length in s:
            held[item] += length
    assert held.tolist() == lengths
    assert 1024 * len(sequences) - sum(lengths) <= 1.1 * packing.SLACK * sum(lengths) + 1024
    plain = _concatenated(lengths)
    cuts, plain_cuts = (sum(map(len, s)) - len(lengths) for s in (sequences, plain))
    spread = _spread([[p[2] for p in s] for s in sequences])
    few, of_first_fit, of_plain = BOUNDS[kind]
    assert cuts <= few * plain_cuts, (cuts, plain_cuts)
    assert spread <= of_first_fit * _spread(_first_fit(lengths)), (spread, _spread(_first_fit(lengths)))
    assert spread <= of_plain * _spread(plain), (spread, _spread(plain))


@pytest.mark.parametrize("seed", range(6))
def test_few_items(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1024, rng.integers(0, 8)).tolist()
    pieces = [p for s in packing.without_short(packing.pack(lengths)) for p in s]
    assert sorted((i, k) for i, start, n in pieces for k in range(start, start + n)) == [(i, k) for i, n in enumerate(lengths) for k in range(n)]
    for s in packing.without_short(packing.pack(lengths)):
        n = sum(p[2] for p in s)
        assert n & (n - 1) == 0 or n >= 960


def test_many_shards(spark):
    rows = [(i, prose(i, 300), "en", "a", 0) for i in range(30)]
    found = packing.pack_documents(documents(spark, rows), shard_tokens=500).collect()
    assert _check(rows, found) <= 64 * len({r.sequence_id for r in found})
