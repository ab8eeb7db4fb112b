"""What must not move between tasks, as there are many more rows of it than of the tables, and numbers on odd inputs."""

import re

import duckdb
import pytest

from tessera import plans
from tessera.operators import metrics
from tessera.plans import recommend
from tessera.sources import domain


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_profiles_and_occupations_are_not_moved(spark, sf_dir):
    plan = _plan(recommend._scores(spark, sf_dir))
    assert "Exchange hashpartitioning" not in plan[: plan.index("Generate inline")]


def test_scores_of_odd_numbers(spark, monkeypatch):
    """Large, negative and missing keys and weights come back from the lists that they are moved in."""
    asked = [(7, 1, 3.0), (-70_000, 1, -2.5), (2**40 + 5, 1, 40.0), (2**40 + 5, 2, 2.0), (None, 2, 1.0), (7, None, 1.0)]
    monkeypatch.setattr(domain, "requires", lambda *_: spark.createDataFrame([(*a, 1) for a in asked], "occupation long, skill long, importance double, target_level int"))
    monkeypatch.setattr(domain, "owned", lambda *_: spark.createDataFrame([(1, 1), (1, None), (2, 2)], "profile long, skill long"))
    monkeypatch.setattr(recommend, "table", lambda *_: spark.range(3))
    found = {(r.profile, r.occupation): (r.score, r.owned, r.missing) for r in recommend._scores(spark, "").collect()}
    assert found == {(1, 7): (0.75, 1, 1), (1, -70_000): (1.0, 1, 0), (1, 2**40 + 5): (0.9524, 1, 1), (2, 2**40 + 5): (0.0476, 1, 1)}


@pytest.mark.parametrize("name", ["skill_gap", "learning_path_gap", "path_plan", "skill_gap_tool"])
def test_what_profiles_lack_is_not_moved(spark, sf_dir, name):
    plan = _plan(plans.queries()[name](spark, sf_dir))
    assert not re.search(r"Join \[profile#\d+L?, skill#", plan)


@pytest.mark.parametrize("answerable", [True, False])
def test_threshold_sweep_without_one_kind(spark, answerable):
    rows = metrics.threshold_sweep(spark.createDataFrame([(1, answerable, 3.0), (2, answerable, 7.0)], "qid long, answerable boolean, signal double"), [5]).collect()
    assert [(r.threshold, r.rejected, r.false_rejects) for r in rows] == [(5.0, 0 if answerable else 1, 1 if answerable else 0)] and rows[0].balanced_accuracy != rows[0].balanced_accuracy


def test_titles_end_within_an_entity(spark, tmp_path):
    rows = [(1, "<title>a &amp;&amp</title>"), (2, "<TITLE x>b &amp;lt; &quot;c&quot; &eacute;&#65;\n d</TITLE>"), (3, "none"), (4, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = plans.queries()["page_titles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(plans.oracle_sql()["page_titles"]).fetchall())


def test_dimension_report_rounds_exactly(spark, tmp_path):
    """Scores that lie between two numbers of four digits go up, whatever the order in which credits are added."""
    flags = "A" * 14 + "R" * 2, "A" * 13 + "N" * 23 + "R" * 44
    spark.createDataFrame([(o, 1, f) for o, fs in enumerate(flags) for f in fs], "l_suppkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "x")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.occupation: r.overall for r in plans.queries()["dimension_report"](spark, str(tmp_path)).collect()}
    points = [100 * f.count("N") + 35 * f.count("A") for f in flags]
    assert found == {o: ((p * 20000 + 100 * len(f)) // (200 * len(f))) / 10000 for o, (p, f) in enumerate(zip(points, flags, strict=True))}


def test_blocks_of_the_index_move_once(spark, sf_dir):
    plan = _plan(plans.queries()["bm25_topk"](spark, sf_dir))
    assert re.search(r"hashpartitioning\(shard#", plan) and "hashpartitioning(group" not in plan


def test_chunks_are_placed_without_moving_texts(spark, tmp_path):
    """Null texts have no lines; blank lines, other line ends and characters beyond the first plane count as they stand."""
    texts = [(1, None), (2, ""), (3, "a" * 40 + "\n\n" + "😀" * 41 + "\r\n" + "b" * 39), (4, "\n" + "c" * 40 + "\n")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = domain.chunks(spark, str(tmp_path))
    assert "hashpartitioning" not in _plan(rows)
    want = [(3, 0, 0, 40, "a" * 40), (3, 2, 42, 84, "😀" * 41 + "\r"), (4, 1, 1, 41, "c" * 40)]
    found = lambda df: sorted(df.select("doc_id", "pos", "start", "end", "text").collect())
    assert found(rows) == want and found(domain.chunks(spark, str(tmp_path), spark.createDataFrame([(4,), (9,), (4,)], "doc_id long"))) == want[2:]


@pytest.mark.parametrize("name", ["parent_contexts", "budget_control"])
def test_pairs_of_questions_and_chunks_are_not_moved(spark, sf_dir, name):
    plan = _plan(plans.queries()[name](spark, sf_dir))
    assert "term#" not in plan and "tf#" not in plan


@pytest.mark.parametrize("name", ["keyword_hit_rate", "split_half", "language_gates", "weight_sweep"])
def test_searches_do_not_run_again(spark, sf_dir, name):
    plan = _plan(plans.queries()[name](spark, sf_dir))
    assert plan.count("FlatMapGroupsInArrow") == (1 if name == "keyword_hit_rate" else 0)
