import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lloyd

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, k=8, rounds=10, width=64):
    """Lloyd's rounds in Python's integers."""
    kept = [(i, [int(np.floor(1024.0 * x)) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    if not centroids:
        return []
    vectors = np.array([v for _, v in kept], object)

    def nearest():
        d = np.array([((vectors - np.array(c, object)) ** 2).sum(axis=1) for c in centroids])
        return d.argmin(axis=0), d.min(axis=0)

    for _ in range(rounds):
        own, _ = nearest()
        for c in range(len(centroids)):
            if n := int((own == c).sum()):
                centroids[c] = [int(s) // n for s in vectors[own == c].sum(axis=0)]
    own, distance = nearest()
    inertia = {c: int(distance[own == c].sum()) for c in set(own.tolist())}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, int(c), int(d), inertia[c], sum(inertia.values()), digest[c]) for (i, _), c, d in zip(kept, own, distance, strict=True)), key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def _table(spark, rows):
    return spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert _rows(lloyd.query(spark, sf_dir)) == brute_force(rows)


@pytest.mark.parametrize("size", [40, lloyd.ROWS])
def test_clusters_copies_ties_and_odd_rows(spark, size):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=6)).tolist()) for i in range(500)]
    # Equal vectors in number, points midway between others (ties), repeated rows and ids, and rows that take no part.
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000 + i, [float(i % 3 - 1)] * 6) for i in range(90)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 5), (3003, [None] + [1.0] * 5), (3004, [float("nan")] * 6), (3005, [float("-inf")] * 6), (3006, [0.0] * 6), (None, [1.0] * 6)]
    rows += rows[:30] + [(5, [0.25] * 6)]
    df = _table(spark, rows).withColumns({c: F.lit("x") for c in ("v", "cluster", "distance", "hash", "rows", "s", "inertia")})
    assert _rows(lloyd.clustered(df, width=6, size=size)) == brute_force(rows, width=6)


def test_few_no_and_large_rows(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 0.5])]
    assert _rows(lloyd.clustered(_table(spark, few), width=2)) == brute_force(few, width=2)
    assert lloyd.clustered(_table(spark, []), width=2).count() == 0
    assert lloyd.clustered(_table(spark, few)).count() == 0
    large = [(i, [5e4 * (i % 7) + 0.1, -9e4 * (i % 5)]) for i in range(60)]
    assert _rows(lloyd.clustered(_table(spark, large), width=2)) == brute_force(large, width=2)


def test_the_cover_tree():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, size=(15, 5))
    rows = (centres[rng.integers(0, 15, 700)] + rng.integers(-40, 40, size=(700, 5))).astype(np.int64)
    tree = lloyd.CoverTree(rows)
    assert sorted(tree.order) == list(range(700)) and (tree.first[0], tree.last[0]) == (0, 700)
    for node, (a, b) in enumerate(tree.children):
        below = rows[tree.order[tree.first[node] : tree.last[node]]]
        apart = np.sqrt(((below - rows[tree.centre[node]]) ** 2).sum(axis=1))
        assert abs(apart.max() - tree.radius[node]) < 1e-6
        if b > a:
            # Children cover their parent's rows, each once, and the parent's centre is one of theirs.
            assert tree.first[a] == tree.first[node] and tree.last[b - 1] == tree.last[node] and (tree.first[a + 1 : b] == tree.last[a : b - 1]).all()
            assert tree.centre[node] in tree.centre[a:b]
    # Pairs of nodes are left out: far fewer distances than rows times centroids.
    own = rows[:8]
    assert (lloyd.clusters(tree, rows, own) == lloyd.squared(rows, own).argmin(axis=1)).all()
    assert lloyd.assign(tree, rows, own)[3] < 0.5 * 700 * 8
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = rng.integers(-5, 5, size=(rng.integers(1, 120), 3))
        c = rng.integers(-5, 5, size=(rng.integers(1, 9), 3))
        assert (lloyd.clusters(lloyd.CoverTree(x), x, c) == lloyd.squared(x, c).argmin(axis=1)).all()
