"""Each query's rows against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import plans

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool) or str(type(x)).find("bool") >= 0:
            return str(bool(x))
        return f"{float(x):.8g}" if hasattr(x, "__float__") and not isinstance(x, str) else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", ["bm25_topk", "fusion_rrf", "prereq_closure", "recommend_coverage", "latest_state"])
def test_same_rows_over_other_partitions(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = _rows(QUERIES[name](spark, sf_dir).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert _rows(QUERIES[name](spark, sf_dir).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pair_picks_equal_one_by_one(spark, duck, sf_dir):
    """The greedy pairs of rounds of joins against going through all candidates in order."""
    rows = duck.sql(ORACLE["pair_candidates"]).df()
    used, want = set(), set()
    for r in rows.sort_values(["apart", "gap", "poorness", "a", "b"]).itertuples():
        if r.a not in used and r.b not in used:
            want.add((r.a, r.b))
            used |= {r.a, r.b}
    assert {(r.a, r.b) for r in QUERIES["pair_picks"](spark, sf_dir).collect()} == want and want
