import pytest

from tessera.llm import mixing
from tests.llm.helpers import ODD, documents, prose


def _targets(sizes, share=1.5, epochs=2, weights=(5, 2, 1)):
    """Water-filling by rounds: clamp what is above its stop, share the excess again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    done = {}
    while True:
        rest = [s for s in names if s not in done]
        left = total - sum(done.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > epochs * sizes[s]]
        if not over:
            return done | {s: level * weight[s] for s in rest}
        done |= {s: epochs * sizes[s] for s in over}


def _check(rows, found):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(len((r[1] or "").encode().split()))
    want = _targets({s: sum(x) for s, x in by_source.items()})
    assert len(found) == len(rows)
    for s, t in want.items():
        own = [r for r in found if r.source == s]
        assert all(r.target == pytest.approx(t) and r.source_size == sum(by_source[s]) for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in found)


@pytest.mark.parametrize("cell", [mixing.CELL, 7])
def test_targets_and_taken_words(spark, cell):
    rows = [(i, prose(i, i % 50), "en", "abcdefg"[i * i % 7] if i % 9 else None, 0) for i in range(400)]
    rows += [(1000 + i, prose(i, 40), "en", "hot", 0) for i in range(200)] + [(2000, "", "en", "nothing", 0)]
    docs = documents(spark, rows, extra=True)
    found = mixing.mix(docs, cell=cell).collect()
    if cell == mixing.CELL:
        _check(rows, found)
    else:
        assert all(abs(sum(r.taken for r in found if r.source == s) - t) <= 100 for s, t in {(r.source, r.target) for r in found})
    assert sorted(map(str, mixing.mix(docs.repartition(3), cell=cell).collect())) == sorted(map(str, found))


def test_odd_rows(spark):
    found = mixing.mix(documents(spark, ODD)).collect()
    assert len(found) == len(ODD)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [(1, None, None, None, None)])).collect()[0].taken == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, "\t" + prose(i, 10 + i % 50), "en", "ab"[i % 2], 0) for i in range(80)]
    docs = documents(spark, rows, extra=True)
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words, texts = {}, {r[0]: r[1].split() for r in rows}
    for r in out.collect():
        own = r.text.split()
        assert own == texts[r.doc_id][: len(own)]
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
    assert words == {d: n for d, n in plan.items() if n}


def test_rows_of_one_doc_id_follow_their_own_plans(spark):
    rows = [(i % 3 or None, prose(i, 10 + i), "en", "ab"[i % 2], 0) for i in range(40)]
    docs = documents(spark, rows)
    targets = {r.source: round(r.target) for r in mixing.targets(mixing.sized(docs)).collect()}
    out = mixing.mixed_documents(docs).collect()
    for source, target in targets.items():
        assert abs(sum(len(r.text.split()) for r in out if r.source == source) - target) <= 1
    assert {r.doc_id for r in out} == {None, 1, 2}
