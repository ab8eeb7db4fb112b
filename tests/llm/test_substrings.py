import random

from tessera.llm import substrings
from tests.llm.helpers import ODD, documents, prose


def _table():
    rng = random.Random(3)
    passages = [prose(100 + i, rng.randint(50, 90)) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(1000 + i * 10 + k, rng.randint(5, 60)) for k in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((30 + i * 3, " \n".join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(5)] + [(700, " ".join(["the"] * 200)), (701, " ".join(["the"] * 90)), (702, "x " + " ".join(["the"] * 60))]
    return rows


def test_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in ODD] + _table()
    for claims in (substrings.CLAIMS, 1, 3):
        got = substrings._with_removals(documents(spark, rows, extra=True), claims).mapInArrow(substrings._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(substrings.brute_force(rows), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, substrings.query(spark, sf_dir).collect())) == sorted(substrings.brute_force(rows))


def test_operator_returns_texts(spark):
    passage = prose(9, 60)
    out = {r.doc_id: r for r in substrings.without_repeats(documents(spark, [(1, f"one {passage}"), (2, f"two {passage} end")])).collect()}
    assert out[1].kept == f"one {passage}" and out[2].kept == "two end"
    assert substrings.without_repeats(documents(spark, [])).count() == 0


def _digests(spark, rows, **kw):
    got = substrings._with_removals(documents(spark, rows), **kw).mapInArrow(substrings._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return sorted(map(tuple, got.collect()), key=repr)


def test_rows_that_share_a_doc_id(spark):
    """Different texts of one doc_id lose their own words only, and none to each other."""
    a, b = prose(1, 70), prose(2, 70)
    rows = [(5, f"{a} x"), (5, f"{b} y"), (5, f"{a} x"), (5, prose(3, 80)), (9, f"{a} z"), (9, f"q {b}"), (3, f"{b} first")]
    assert _digests(spark, rows) == sorted(substrings.brute_force(rows), key=repr)


def test_a_common_passage_in_very_many_contexts(spark):
    """2,000 different runs of one anchor go through automata, in groups of bounded size."""
    rng, passage = random.Random(7), prose(50, 56)
    rows = [(i, f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(12))} {passage} {' '.join(f'v{rng.randrange(10**6)}' for _ in range(12))}") for i in range(2000)]
    rows += [(5000 + i, rows[i][1].replace("v", "u", 1)) for i in range(50)]
    assert _digests(spark, rows, claims=100) == sorted(substrings.brute_force(rows), key=repr)


def test_matching_statistics_by_words():
    """Masks come from words, whatever hashes have brought together."""
    words = [f"w{i}".encode() for i in range(60)]
    other = [*words[:30], b"another", *words[31:]]
    masks = substrings._shard_masks([(1, 1, 1, 10, b" ".join(words))], [(1, 2, 2, 20, b" ".join([*words, b"x"])), (1, 3, 3, 5, b" ".join(words)), (1, 4, 4, 30, b" ".join(other))])
    assert masks == [(1, 2, 2, (1 << 11) - 1)]


def test_very_many_equal_rows_are_looked_at_once(spark):
    """10,000 equal rows that owe all of their words: one row of removals, each run in it once."""
    text = prose(4, 150)
    rows = [(1, f"{text} start"), (2, f"x {text}"), (2, prose(5, 90))] + [(7, text)] * 10_000
    found = substrings.removals(substrings._told_apart(documents(spark, rows))[1]).where("doc_id = 7").collect()
    assert len(found) == 1 and len(found[0].removed) == len(substrings.runs_of(substrings.words_of(text))[0])
    digest = substrings.brute_force(rows[:4])
    assert _digests(spark, rows) == sorted([*digest[:3], *[digest[3]] * 10_000], key=repr)


def test_texts_of_one_doc_id_whose_hashes_clash(spark, monkeypatch):
    """Where two texts of a doc_id share a hash another seed tells them apart."""
    real, calls = substrings.F.xxhash64, []

    def clashing(*columns):
        # The first hash of all is made to clash: it is the one of the text alone.
        if len(columns) == 1 and isinstance(columns[0], str) and columns[0] == "text":
            calls.append(1)
            return substrings.F.lit(5).cast("long")
        return real(*columns)

    rows = [(5, prose(1, 70)), (5, prose(2, 80)), (3, prose(1, 70)), (5, prose(1, 70))]
    want = sorted(substrings.brute_force(rows), key=repr)
    monkeypatch.setattr(substrings.F, "xxhash64", clashing)
    got = _digests(spark, rows)
    assert calls and got == want
