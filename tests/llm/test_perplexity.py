import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import perplexity as P
from tests.llm.helpers import ODD, documents, prose

WORDS = prose(3, 200, pool=150).split()


def base(text):
    """The contract, literally."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_figures_equal_the_contract(spark, sf_dir):
    rows = ODD + [(100, "a b c d e " * 7, "en", "a", 0), (101, "x\n\nx\n \nx \nx", "en", "a", 0), (102, "# * $ % & | < > \x85 \xa0 z", "en", "a", 0), (103, "a b c d e a b c d e", "en", "a", 0)]
    rows += [(1000 + r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts = {r[0]: r[1] for r in rows}
    for r in P.judge(documents(spark, rows, extra=True)).collect():
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def _kneser_ney(texts):
    """Probability of an n-gram by definition, with dictionaries: n-grams of one text alone do not count."""
    grams = {t: Counter(("\n" * (P.ORDER - 1) + t)[i : i + P.ORDER] for i in range(len(t))) for t in texts}
    every = Counter()
    for t in texts:
        every.update(grams[t])
    counts = {P.ORDER: Counter({g: n if sum(g in x for x in grams.values()) > 1 else 0 for g, n in every.items()})}
    for k in range(P.ORDER - 1, 0, -1):
        counts[k] = Counter()
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] += n > 0
    disc = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
            disc[k] = [x if 0 < x <= i else i / 2 for i, x in enumerate(d, 1)]
        else:
            disc[k] = [0.5, 1.0, 1.5]
    under = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            if n:
                under[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / len(counts[1])
        own = under[k].get(g[:-1])
        if not own:
            return p(g[1:])
        n = counts[k][g]
        d = disc[k][min(n, 3) - 1] if n else 0
        return (n - d) / sum(own) + sum(disc[k][min(x, 3) - 1] for x in own) / sum(own) * p(g[1:])

    return p


TEXTS = [prose(i, 60, pool=40) for i in range(12)] + [prose(1, 60, pool=40), "", "A", "12 $$", "été \U0001f600 中文字符 и кириллица", "中文字符 и буквы", "\x00\x00 nul"]


@pytest.mark.parametrize("hot", [P.HOT, 300, 0])
def test_perplexity_equals_definition(spark, hot, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 500)
    p = _kneser_ney(TEXTS)
    found = {r.doc_id: r.perplexity for r in P.judge(documents(spark, list(enumerate(TEXTS))), hot=hot).collect()}
    for i, t in enumerate(TEXTS):
        logs = [math.log(p(("\n" * (P.ORDER - 1) + t)[k : k + P.ORDER])) for k in range(len(t))]
        assert found[i] == pytest.approx(math.exp(-sum(logs) / max(1, len(logs))), rel=1e-9)


def test_bands_equal_definition(spark):
    """kept against quartiles and deviations computed row by row."""
    rows = [(i, prose(i, 20 + i % 70), "en" if i % 3 else None, "a", 0) for i in range(120)] + [(500 + i, "|".join("xyzw"[k * i % 4] for k in range(90)) + " a" * 12, "en", "a", 0) for i in range(4)]
    found = P.judge(documents(spark, rows)).collect()
    for lang in ("en", None):
        own = [r for r in found if r.lang == lang and not r.base_failed]
        bins = sorted(math.floor(r.entropy * P.STEP) for r in own)
        low, middle, high = ((bins[math.ceil(len(bins) * x) - 1] + 0.5) / P.STEP for x in (0.25, 0.5, 0.75))
        n, s, q = (sum(getattr(r, c) for r in own) for c in ("n", "log_sum", "square_sum"))
        at = {r.doc_id: (math.sqrt((2 * (middle - low) / 1.349 + 1 / P.STEP) ** 2 + (q / n - (s / n) ** 2) / r.n), math.sqrt((2 * (high - middle) / 1.349 + 1 / P.STEP) ** 2 + (q / n - (s / n) ** 2) / r.n)) for r in own}
        depths = sorted(math.floor((r.entropy - middle) / at[r.doc_id][0] * P.STEP) for r in own)
        deep, half = ((depths[math.ceil(len(depths) * x) - 1] + 0.5) / P.STEP for x in (0.25, 0.5))
        deepest = half - P.BELOW * (2 * (half - deep) / 1.349 + 1 / P.STEP)
        for r in own:
            below, above = at[r.doc_id]
            assert r.kept == (middle + deepest * below <= r.entropy <= middle + P.ABOVE * above)


def test_hot_arrays_find_what_they_hold():
    rng = random.Random(3)
    grams = sorted({"".join(rng.choice("ab中\n") for _ in range(P.ORDER)) for _ in range(400)})
    hot = P.Hot(pa.table({"gram": grams[:300], "log": [-float(i) for i in range(300)]}))
    log, known = hot.of(P.hashes_of(np.array([ord(c) for g in grams for c in g], np.uint32))[:: P.ORDER])
    assert known.tolist() == [True] * 300 + [False] * (len(grams) - 300)
    assert log[:300].tolist() == [-float(i) for i in range(300)]


def test_bands_reject_junk_and_keep_prose(spark):
    rows = [(i, prose(7, 3000)[i * 20 : i * 20 + 400 + i], "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, "".join(chr(65 + (i * 7 + k * k * 11) % 58) for k in range(200)) + " q" * 12, "en", "a", 0) for i in range(5)]
    found = {r.doc_id: r for r in P.judge(documents(spark, rows)).collect()}
    assert sum(found[i].kept for i in range(300)) >= 295
    assert not any(found[1000 + i].kept for i in range(5))


def test_passing_keeps_columns_and_empty_tables(spark):
    docs = documents(spark, ODD, extra=True)
    assert P.passing(docs).columns == docs.columns
    assert P.judge(documents(spark, [])).count() == 0


def test_shuffled_and_invented_words_score_worse(spark):
    rng = random.Random(5)
    follow = {w: [rng.choice(WORDS) for _ in range(8)] for w in WORDS}

    def clean():
        out = [rng.choice(WORDS)]
        while len(out) < 120:
            out.append(rng.choice(follow[out[-1]]))
        return out

    rows = [(i, " ".join(clean()), "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.sample(x := clean(), len(x))), "en", "a", 0) for i in range(5)]
    rows += [(2000 + i, " ".join("".join(rng.sample(w, len(w))) + "ae" for w in clean()), "en", "a", 0) for i in range(5)]
    rows += [(None, " ".join(clean()), "en", "a", 0), (None, "junk", "en", "a", 0), (7, "junk", "en", "a", 0)]
    docs = documents(spark, rows)
    found = {r.doc_id: r.kept for r in P.judge(docs).where("doc_id <> 7 and doc_id is not null").collect()}
    assert sum(found[i] for i in range(300) if i != 7) >= 294
    assert not any(found[k + i] for k in (1000, 2000) for i in range(5))
    # A junk row drops no other row of its doc_id.
    kept = P.passing(docs).where("doc_id is null or doc_id = 7").collect()
    assert sorted(r.doc_id is None for r in kept) == [False, True] and all(r.text != "junk" for r in kept)


def test_templated_texts_fall_below_the_band(spark):
    """Texts put together from the same sentences, none twice in a text, are too predictable; prose stays."""
    rng = random.Random(8)
    sentences = [prose(900 + i, 12) for i in range(30)]
    rows = [(i, prose(i, 300 + i % 100), "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, ". ".join(rng.sample(sentences, 24)), "en", "a", 0) for i in range(60)]
    found = {r.doc_id: r for r in P.judge(documents(spark, rows)).collect()}
    assert not any(found[1000 + i].base_failed or found[1000 + i].kept for i in range(60))
    assert all(found[1000 + i].perplexity < found[1000 + i].lower for i in range(60))
    assert sum(found[i].kept for i in range(300)) >= 295
