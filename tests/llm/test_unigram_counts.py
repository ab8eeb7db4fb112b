import math
import random

from tessera.llm import unigram_counts as U
from tests.llm.helpers import ODD, documents


def _brute_force(pieces, word):
    """Best score and its number of pieces over all segmentations, the first of equal ones by rising start."""
    vocab, unknown = dict(pieces), min(s for _, s in pieces) - U.UNKNOWN
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            if piece in vocab:
                x = best[start][0] + vocab[piece]
                if best[end] is None or x > best[end][0]:
                    best[end] = (x, [*best[start][1], piece])
        if word[end - 1] not in vocab:
            x = best[end - 1][0] + unknown
            if best[end] is None or x > best[end][0]:
                best[end] = (x, [*best[end - 1][1], None])
    count = sum(not (p is None and i and best[-1][1][i - 1] is None) for i, p in enumerate(best[-1][1]))
    return count, best[-1][0]


def test_counts_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): -rng.choice([1.0, 2.0, 3.0]) for _ in range(12)}
        counter = U.Counter(list(pieces.items()))
        for _ in range(20):
            word = "▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
            want = _brute_force(list(pieces.items()), word)
            got = counter.viterbi(word)
            assert got[0] == want[0] and math.isclose(got[2], want[1])


def test_counts_over_a_table(spark):
    counter = U.Counter(U.vocabulary())
    rows = ODD + [(100, "hello world ☃☃ hello", "en", "a", 0)]
    texts = {r[0]: r[1] for r in rows}
    found = U.token_counts(documents(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    for r in found:
        words = (texts[r.doc_id] or "").encode().split()
        each = [counter.viterbi(U.MARK + w.decode()) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(x[0] for x in each), sum(x[1] for x in each))
    assert U.token_counts(documents(spark, [])).count() == 0


def test_counts_equal_a_unigram_tokenizer(spark, sf_dir):
    from tokenizers.models import Unigram

    vocab = U.vocabulary()
    counter = U.Counter(vocab)
    model = Unigram([("<unk>", 0.0), *vocab], 0)
    words = {w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() for w in r.text.split()}
    for w in [*sorted(words)[:5000], "\U0001f9ff" * 5, "a\U0001f9ffb\U0001f9ff\U0001f9ff", "e\u0301"]:
        assert counter.viterbi(U.MARK + w)[0] == len(model.tokenize(U.MARK + w)), w
    assert counter.viterbi(U.MARK + "\U0001f9ff" * 5)[:2] == (2, 1)


def test_unbroken_long_text():
    """Two million characters without a blank, in memory bounded by the text."""
    import tracemalloc

    counter = U.Counter([("ab", -1.0), ("abc", -1.5), ("c", -2.0), ("▁", -3.0), ("a" * 30, -4.0)])
    text = "abcab" * 400_000
    tracemalloc.start()
    got = counter.of(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:3] == (1, 1 + 2 * 400_000, 0) and got[3] == -3.0 - 2.5 * 400_000
    assert peak < 10 * len(text) and not counter.cache
