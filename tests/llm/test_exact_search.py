import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_search

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, k=20, every=20):
    """Lists of (vec_id, score) by query, in Python's integers."""
    given = {(i, tuple(int(np.floor(64.0 * x)) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = {}
    for i, q in given:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in given if j != i)
            out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return {i: sorted(x) for i, x in out.items() if any(x)}


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return {i: [x] for i, x in out.items()}


def _table(spark, rows):
    return spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert _found(exact_search.query(spark, sf_dir)) == brute_force(rows)


@pytest.mark.parametrize("settings", [{}, {"shard": 64}, {"shard": 32, "near": 1}, {"shard": 32, "top": 2}])
def test_odd_rows_over_shards(spark, settings):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * rng.uniform(0.1, 4)).tolist()) for i in range(500)]
    # Many copies of one vector, ties of scores, a zero and a short vector, and rows that take no part.
    rows += [(1000 + i, rows[3][1]) for i in range(300)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 12), (2060, [1.0, None] + [0.0] * 10), (2080, [float("nan")] * 12), (2100, [float("inf")] + [0.0] * 11), (None, [1.0] * 12), (2120, [1.0, 2.0])]
    rows += rows[:25]
    df = _table(spark, rows).withColumns({c: F.lit("x") for c in ("v", "h1", "cell", "shard", "asked", "score", "rank", "least", "query_id")})
    assert _found(exact_search.top_scores(df, F.col("vec_id") % 20 == 0, **settings)) == brute_force(rows)


def test_clusters_leave_cells_out(spark):
    """Copies of queries that go to other shards are a small part of queries times shards."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = _table(spark, rows)
    done = exact_search.Search(df, F.col("vec_id") % 20 == 0, shard=100)
    assert done.sent < 0.3 * done.asked * 32
    assert _found(exact_search.top_scores(df, F.col("vec_id") % 20 == 0, shard=100)) == brute_force(rows)


def test_few_no_and_large_rows(spark):
    is_query = F.col("vec_id") % 20 == 0
    assert _found(exact_search.top_scores(_table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]), is_query)) == {0: [[(1, 2048), (2, -4096)]]}
    assert exact_search.top_scores(_table(spark, [(20, [1.0])]), is_query).count() == 0
    assert exact_search.top_scores(_table(spark, []), is_query).count() == 0
    assert exact_search.top_scores(_table(spark, [(1, [1.0])]), is_query).count() == 0
    # Beyond the integers that doubles hold.
    large = [(i, [3e5 * (i + 1) + 0.5, -2e5 * i]) for i in range(50)]
    assert _found(exact_search.top_scores(_table(spark, large), is_query)) == brute_force(large)
    with pytest.raises(Exception, match="do not fit a long"):
        exact_search.top_scores(_table(spark, [(0, [1e9]), (1, [1e9])]), is_query).collect()


def test_the_tree_is_tight_and_leaves_leaves_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-500, 500, size=(30, 8))
    rows = (centres[rng.integers(0, 30, 3000)] + rng.integers(-10, 10, size=(3000, 8))).astype(np.int64)
    tree = exact_search.Tree(rows, 50)
    assert sorted(np.concatenate(tree.leaves)) == list(range(3000))
    for leaf, low, high in zip(tree.leaves, *tree.levels[-1], strict=True):
        assert (rows[leaf].min(axis=0) == low).all() and (rows[leaf].max(axis=0) == high).all()
    queries = rows[:40]
    reach = exact_search.bounds(queries, *tree.levels[-1])
    assert all((reach[:, i] >= (queries @ rows[leaf].T).max(axis=1)).all() for i, leaf in enumerate(tree.leaves))
    least = np.full(40, np.iinfo(np.int64).min)
    query, row, score, compared = exact_search.search(rows, np.arange(3000), queries, np.arange(40), least, 5, 50)
    want = queries @ rows.T
    want[np.arange(40), np.arange(40)] = -(10**15)
    for i in range(40):
        assert [(r, s) for r, s in zip(row[query == i], score[query == i], strict=True)] == [(r, want[i, r]) for r in np.lexsort((np.arange(3000), -want[i]))[:5]]
    assert compared < 0.3 * want.size
