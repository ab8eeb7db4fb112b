"""Components, cycles and relaxation against plain versions on random graphs; interval joins against all pairs."""

import random
import re

import pytest

from tessera import plans
from tessera.operators import graph, intervals
from tessera.sources import domain


def _components(nodes, edges):
    """Tarjan's components: the smallest node of each node's component."""
    out, index, low, stack, on, found = {}, {}, {}, [], set(), {}
    for a, b in edges:
        out.setdefault(a, []).append(b)

    def visit(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        for w in out.get(v, []):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            own = []
            while True:
                own.append(stack.pop())
                on.discard(own[-1])
                if own[-1] == v:
                    break
            found.update(dict.fromkeys(own, min(own)))

    for v in sorted(nodes):
        if v not in index:
            visit(v)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_witness(spark, seed):
    rng = random.Random(seed)
    n = 24
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(26 + 4 * seed)]
    edges += [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103)]  # cycles with a way between them
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = sorted({v for e in edges for v in e} | {200})
    want = _components(nodes, edges)
    got = {r.node: r.component for r in graph.components(df, spark.createDataFrame([(v,) for v in nodes], "node long")).collect()}
    assert got == want
    several = {c for c in want.values() if sum(x == c for x in want.values()) > 1}
    on_cycles = {v for v in nodes if want[v] in several} | {a for a, b in edges if a == b}
    assert {r.node for r in graph.cyclic(df).collect()} == on_cycles
    cycle = [r.node for r in graph.witness(df).orderBy("step").collect()]
    assert cycle[0] == min(on_cycles) and len(set(cycle)) == len(cycle)
    assert all((a, b) in set(edges) for a, b in zip(cycle, cycle[1:] + cycle[:1], strict=True))
    apart = {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    assert {tuple(r) for r in graph.condensed(df, graph.components(df)).collect()} == apart


def test_no_cycle(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert graph.cyclic(df).count() == 0 and graph.witness(df).count() == 0
    assert graph.components(df.limit(0)).count() == 0


def test_relaxation_reaches_along_all_ways(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    values = {v: rng.randrange(100) for v in range(30)}
    want, changed = dict(values), True
    while changed:
        changed = False
        for a, b in edges:
            if want[a] > want[b]:
                want[b], changed = want[a], True
    own = spark.createDataFrame(list(values.items()), "node long, value long")
    got = graph.relaxed(own, spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.value for r in got.collect()} == want
    held = spark.createDataFrame([(1, 5), (1, 7), (2, 9)], "owner long, node long")
    back = {}
    for owner, node in ((1, 5), (1, 7), (2, 9)):
        reach = {node}
        while more := {a for a, b in edges if b in reach} - reach:
            reach |= more
        back.setdefault(owner, set()).update(reach)
    assert {tuple(r) for r in graph.ancestors(held, spark.createDataFrame(edges, "src long, dst long")).collect()} == {(o, v) for o, x in back.items() for v in x}


@pytest.mark.parametrize("width", [1, 7, 64])
def test_interval_joins_equal_all_pairs(spark, width):
    rng = random.Random(width)
    left = [(rng.randrange(3), s, s + rng.randrange(0, 30)) for s in (rng.randrange(200) for _ in range(60))] + [(9, 0, 5)]
    right = [(rng.randrange(3), s, s + rng.randrange(0, 50)) for s in (rng.randrange(200) for _ in range(60))] + [(9, 5, 9), (9, 4, 4)]
    a, b = spark.createDataFrame(left, "k long, s long, e long"), spark.createDataFrame(right, "k long, start long, end long")
    found = intervals.overlapping(a, b, "k", ("s", "e"), ("start", "end"), width)
    want = sorted((k, s, e, x, y) for k, s, e in left for q, x, y in right if k == q and s < y and x < e and s < e and x < y)
    assert sorted(tuple(r) for r in found.select("k", "s", "e", "start", "end").collect()) == want
    points = spark.createDataFrame([(k, s) for k, s, _ in left], "k long, p long")
    want = sorted((k, s, x, y) for k, s, _ in left for q, x, y in right if k == q and x <= s < y)
    assert sorted(tuple(r) for r in intervals.holding(points, b, "k", "p", ("start", "end"), width).select("k", "p", "start", "end").collect()) == want
    # The join's keys are the document and the bin, so a long document is dealt over many tasks.
    assert "_bin" in found._jdf.queryExecution().optimizedPlan().toString()


def test_neighbours_equal_counting_the_adjacency(spark):
    """Edges both ways, again, in loops, to evidence, to unknown or missing ends, and a node with very many."""
    rows = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("a", "chunk:1"), ("a", "gone"), ("gone", "b"), ("gone", "lost"), ("chunk:2", "a"), (None, "a"), ("a", None)]
    rows += [("hub", f"n{i % 300}") for i in range(900)]
    edges = spark.createDataFrame(rows, "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in ["a", "b", "c", "c", "hub", "alone", None, *(f"n{i}" for i in range(250))]], "node string")
    near = {(a, b) for x, y in rows for a, b in ((x, y), (y, x))}
    known = {r.node for r in nodes.collect()} - {None}
    want = {}
    for a, b in sorted((a, b) for a, b in near if a in known and b in known):
        want.setdefault(a, []).append(b)
    assert len(want["hub"]) == 250
    for tasks in (1, 3):
        found = graph.neighbours(edges, nodes, tasks)
        assert sorted(map(tuple, found.collect())) == sorted((a, len(b), b[0]) for a, b in want.items())
        assert sorted(map(tuple, graph.adjacency(edges, nodes, tasks=tasks).collect())) == sorted((a, b) for a, bs in want.items() for b in bs)


def test_edges_are_dealt_out_by_their_number(spark, sf_dir, monkeypatch):
    """Neither all nodes nor more edges than some number lie in a task, whatever the session's setting; the nodes are not sent to all."""
    monkeypatch.setattr(domain, "ROWS_A_TASK", 500)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    tasks = -(-rows // 500)
    for name, deal in (("neighbors_1hop", f"share#\\d+L?, {2 * tasks}"), ("edge_endpoints", f"occupation#\\d+L?, skill#\\d+L?, {tasks}")):
        plan = plans.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\([^)]*{deal}\), REPARTITION_BY_NUM", plan)
        assert name != "neighbors_1hop" or not re.search(r"BroadcastHashJoin [^\n]*node#", plan)
