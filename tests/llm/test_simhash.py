import re

import xxhash

from tessera.llm import simhash
from tests.llm.helpers import ODD, documents, prose


def brute_force(rows):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            first[root(i)] = min(first.get(root(i), doc), doc)
    return sorted(((d, f"{p:016x}", first.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def _query(docs, **kw):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in simhash.near_duplicates(docs, **kw).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()), key=repr)


def test_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in ODD if r[0] != 6]
    base = prose(5, 400)
    rows += [(100 + i, base + f" tail{i}" * (i % 7)) for i in range(60)] + [(200 + i, prose(i, 6, 8)) for i in range(80)]
    docs = documents(spark, rows, extra=True)
    assert _query(docs) == brute_force(rows)
    assert _query(docs, shard=10) == brute_force(rows)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in simhash.query(spark, sf_dir).collect()), key=repr) == brute_force(rows)


def test_keeps_one_of_each_group(spark):
    rows = [(1, prose(1, 50)), (2, prose(1, 50)), (3, prose(2, 50)), (None, prose(3, 50))]
    docs = documents(spark, rows, extra=True)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == [1, 3, None]
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_keep_one_keeps_one_row_of_each_group(spark):
    rows = [(None, prose(1, 50)), (None, prose(1, 50)), (None, prose(2, 50)), (5, prose(2, 50)), (5, prose(2, 50)), (5, prose(3, 50)), (2, prose(4, 50)), (2, prose(4, 50))]
    kept = simhash.keep_one(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(None, prose(1, 50)), (5, prose(2, 50)), (5, prose(3, 50)), (2, prose(4, 50))], key=repr)


def test_three_different_bits_share_a_shard():
    import random

    rng, masks = random.Random(1), [m % (1 << 64) for m in simhash.masks()]
    assert len(masks) == 20 and min(m.bit_count() for m in masks) >= 31
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 3))
        assert any(a & m == b & m for m in masks)


def test_groups_over_many_batches(spark):
    """Blocks of one shard meet in pairs, also where groups end inside and between batches."""
    rng = __import__("random").Random(2)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        found = {shard: [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), shard).collect()] for shard in (20_000, 40, 7)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = _components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3])
    for pairs in found.values():
        assert all(((a ^ b) % (1 << 64)).bit_count() >= 1 for a, b in pairs)
        assert _components(signed, pairs) == want


def _components(nodes, pairs):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}
