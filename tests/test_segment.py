"""Best cuts against all cuts of short runs."""

import itertools
import random

from tessera.operators import segment

WORDS = {"中": 5, "国": 3, "中国": 9, "国人": 4, "人": 6, "人民": 7, "中国人": 2, "民": 1, "工程": 3, "程师": 1, "工程师": 2}


def _best(run, weight, unknown):
    """The best of all cuts into words and single characters."""
    found = []
    for marks in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        ends = [i + 1 for i, m in enumerate(marks) if m] + [len(run)]
        pieces = [run[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        own = [weight.get(p, unknown if len(p) == 1 else None) for p in pieces]
        if None not in own:
            found.append((round(sum(own), 6), -len(pieces), [len(p) for p in pieces], pieces))
    return max(found)[3]


def test_cuts_equal_the_best_of_all():
    weight, unknown = segment.weights(WORDS)
    rng = random.Random(1)
    for _ in range(300):
        run = "".join(rng.choice("中国人民工程师好") for _ in range(rng.randint(1, 9)))
        assert segment.cut(run, weight, unknown, 3) == _best(run, weight, unknown)


def test_texts_of_both_scripts(spark):
    docs = spark.createDataFrame([(1, "中国人民 C++ 工程师 X"), (2, ""), (3, None), (4, "好好")], "doc_id long, text string")
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    got = {r.doc_id: r.tokens for r in segment.segmented(docs, words).collect()}
    assert got == {1: ["中国", "人民", "c++", "工程师", "x"], 2: [], 3: [], 4: ["好", "好"]}
    assert segment.segmented(docs, words.limit(0)).where("doc_id = 1").first().tokens[:2] == ["中", "国"]


def test_a_run_that_texts_repeat_is_cut_once(monkeypatch):
    """The cut of a run is remembered, and forgetting changes nothing."""
    weight, unknown = segment.weights(WORDS)
    made, plain = [], segment.cut
    monkeypatch.setattr(segment, "cut", lambda run, *rest: made.append(run) or plain(run, *rest))
    runs = ["中国人民", "工程师", "中国人", "中国人民", "好" * 100, "工程师", "好" * 100]
    pieces = segment.cutter(weight, unknown, 3)
    assert [pieces(r) for r in runs] == [plain(r, weight, unknown, 3) for r in runs]
    assert made == ["中国人民", "工程师", "中国人", "好" * 100, "好" * 100]
    monkeypatch.setattr(segment, "RUNS", 1)
    pieces = segment.cutter(weight, unknown, 3)
    assert [pieces(r) for r in runs] == [plain(r, weight, unknown, 3) for r in runs]
