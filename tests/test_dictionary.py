"""Names in texts against looking for each name in each text."""

import random

import pytest

from tessera.operators import dictionary, graph


def _tables():
    rng = random.Random(1)
    names = {"".join(rng.choice("abé中") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"a b", "b"}
    texts = {i: "".join(rng.choice("abé中 ") for _ in range(rng.randint(0, 80))) for i in range(50)} | {100: "", 101: None}
    return names, texts


@pytest.mark.parametrize("size", [dictionary.BROADCAST, 20])
def test_mentions_equal_looking_for_each_name(spark, size):
    names, texts = _tables()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = spark.createDataFrame([(n,) for n in names] + [("",), ("b",), (None,)], "name string")
    found = dictionary.mentions(docs, rows, size)
    want = {(i, n, t.find(n), sum(t.startswith(n, k) for k in range(len(t)))) for i, t in texts.items() for n in names if t and n in t}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for i, t in texts.items():
        own = [r.name for r in dictionary.longest_first(found).where(f"doc_id = {i}").orderBy("place").collect()] if i < 6 else None
        if own is not None:
            assert own == sorted((n for n in names if n in t), key=lambda n: (-len(n), n))


def test_nodes_by_their_longest_name(spark):
    docs = spark.createDataFrame([(1, "a red ring and a ring"), (2, "nothing")], "doc_id long, text string")
    entries = spark.createDataFrame([("n1", "ring"), ("n1", "red ring"), ("n2", "ring"), ("n3", "gear")], "node string, name string")
    found = dictionary.nodes_in(dictionary.mentions(docs, entries), entries)
    assert {tuple(r) for r in found.collect()} == {(1, "n1", "red ring"), (1, "n2", "ring")}
    assert dictionary.mentions(docs, entries.limit(0)).count() == 0
    assert dictionary.mentions(docs.limit(0), entries).count() == 0


def test_adjacency_without_evidence_and_unknown_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "chunk:1"), ("a", "gone"), ("c", "a")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert {tuple(r) for r in graph.adjacency(edges, nodes).collect()} == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
