"""Clipping and windows over anchors against plain versions."""

import random

from tessera.operators import anchors, viewport


def test_edges_are_cut_at_a_view(spark):
    rng = random.Random(1)
    rows = [(i, *(float(rng.randint(-30, 130)) for _ in range(4))) for i in range(200)]
    rows += [(900, 10.0, 10.0, 10.0, 90.0), (901, -5.0, 50.0, 105.0, 50.0), (902, 5.0, 5.0, 5.0, 5.0), (903, -5.0, 0.0, -5.0, 100.0), (904, 0.0, 0.0, 100.0, 100.0)]
    got = {r.id: (r.x0, r.y0, r.x1, r.y1) for r in viewport.clipped(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double"), 0, 0, 100, 100).collect()}
    for i, x0, y0, x1, y1 in rows:
        # Points along the edge: those inside are those of the cut edge.
        steps = [k / 2000 for k in range(2001)]
        inside = [t for t in steps if 0 <= x0 + (x1 - x0) * t <= 100 and 0 <= y0 + (y1 - y0) * t <= 100]
        if len(inside) > 1 or i == 902:
            a, b = min(inside), max(inside)
            assert all(abs(p - q) < 0.2 for p, q in zip(got[i], (x0 + (x1 - x0) * a, y0 + (y1 - y0) * a, x0 + (x1 - x0) * b, y0 + (y1 - y0) * b), strict=True))
        elif not inside and i not in (901,):
            assert i not in got or abs(got[i][0] - got[i][2]) + abs(got[i][1] - got[i][3]) < 0.2


def test_edges_end_at_their_nodes_boxes(spark):
    rows = [(0.0, 0.0, 100.0, 0.0), (0.0, 0.0, 0.0, 100.0), (0.0, 0.0, 100.0, 100.0), (5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 5.0, 0.0)]
    got = [tuple(r) for r in viewport.trimmed(spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double"), 20, 10).collect()]
    assert got == [(20.0, 0.0, 80.0, 0.0), (0.0, 10.0, 0.0, 90.0), (10.0, 10.0, 90.0, 90.0), (5.0, 5.0, 5.0, 5.0), (5.0, 0.0, 0.0, 0.0)]
    camera = viewport.camera(spark.createDataFrame([(0.0, 0.0), (400.0, 100.0)], "x double, y double"), 240, 240, 40).first()
    assert tuple(camera) == (200.0, 50.0, 0.5)
    assert viewport.camera(spark.createDataFrame([], "x double, y double"), 240, 240, 40).count() == 0


def test_smallest_windows_equal_trying_all(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        rows.append((i, 1, text, [rng.choice(["a", "b", "ab", "ca", "bc", "cc", "abc"]) for _ in range(rng.randint(1, 3))]))
    rows += [(500, 1, None, ["a"]), (501, 1, "a", None), (502, 1, "a", [])]
    want = {}
    for i, _, text, own in rows:
        if text and own:
            spans = [(e - s, s, e) for s in range(len(text)) for e in range(s + 1, len(text) + 1) if all(a in text[s:e] for a in own)]
            if spans:
                want[i] = min(spans)[1:]
    got = {r.qid: (r.start, r.end) for r in anchors.windows(spark.createDataFrame(rows, "qid long, doc_id long, text string, anchors array<string>")).collect()}
    assert got == want and len(want) > 50


def test_terms_of_cut_edges_are_worked_out_once_a_row(spark):
    """A filter that is moved down would hold the whole terms at each place where it needs them."""
    rows = spark.createDataFrame([(0.0, 0.0, 100.0, 10.0), (5.0, 5.0, 5.0, 5.0), (-9.0, 0.0, -5.0, 9.0), (None, 0.0, 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    cut = viewport.clipped(viewport.trimmed(rows, 20, 10), 0, 0, 60, 60)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("abs(") == 2
    assert [tuple(r) for r in cut.collect()] == [(20.0, 2.0, 60.0, 6.0), (5.0, 5.0, 5.0, 5.0)]
