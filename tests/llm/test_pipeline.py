import math
import random
import re

import corpus_pipeline
from tessera.llm import mixing, perplexity, pii, simhash
from tests.llm import test_mixing, test_packing, test_perplexity
from tests.llm.helpers import ODD, documents, prose


def test_stages_return_documents_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf_dir).cache()
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            kept = out
    n = {k: v.count() for k, v in seen.items()}
    assert 0 < n["simhash_near_dedup"] < n["quality_rules"] < docs.count()
    assert n["pii"] == n["simhash_near_dedup"]
    assert sum(len(r.base) for r in pii.find(seen["pii"]).collect()) == 0
    assert seen["packing"].select("doc_id").distinct().count() == seen["source_mixing"].select("doc_id").distinct().count()
    # How often documents are cut depends on how rows lie in tasks; what is packed does not.
    packed = [sorted((d, sum(r.length for r in rows if r.doc_id == d)) for d in {r.doc_id for r in rows}) for rows in (seen["packing"].collect(), corpus_pipeline.run(spark, sf_dir).collect())]
    assert packed[0] == packed[1]
    for v in seen.values():
        v.unpersist()


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    for rows in (ODD, []):
        docs = documents(spark, rows + [(900 + i, prose(i, 40)) for i in range(5 * bool(rows))])
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir).count()
            if name == "pii":
                assert out == n
            elif name in ("quality_rules", "simhash_near_dedup"):
                assert (0 < out < n) if n else out == 0
            else:
                assert out > 0 if n else out == 0


def _plain_quality(rows):
    """The rows that the rules and the bands keep, by definition."""
    p = test_perplexity._kneser_ney([r[1] or "" for r in rows])
    figures = []
    for r in rows:
        text = r[1] or ""
        logs = [math.log(p(("\n" * (perplexity.ORDER - 1) + text)[i : i + perplexity.ORDER])) for i in range(len(text))]
        base = test_perplexity.base(text)
        figures.append((-sum(logs) / max(1, len(logs)), len(logs), sum(logs), sum(x * x for x in logs), base[0] < 10 or 100 * base[4] > 20 * base[0]))
    kept, step = [], perplexity.STEP

    def quartiles(values):
        bins = sorted(math.floor(v * step) for v in values)
        return ((bins[math.ceil(len(bins) * share) - 1] + 0.5) / step for share in (0.25, 0.5, 0.75))

    for r, (entropy, n, _, _, failed) in zip(rows, figures, strict=True):
        if failed:
            continue
        own = [f for f, o in zip(figures, rows, strict=True) if o[2] == r[2] and not f[4]]
        low, middle, high = quartiles([f[0] for f in own])
        variance = sum(f[3] for f in own) / sum(f[1] for f in own) - (sum(f[2] for f in own) / sum(f[1] for f in own)) ** 2
        below, above = (lambda size, d=d: math.sqrt((2 * d / 1.349 + 1 / step) ** 2 + variance / size) for d in (middle - low, high - middle))
        deep, half, _ = quartiles([(f[0] - middle) / below(f[1]) for f in own])
        deepest = half - perplexity.BELOW * (2 * (half - deep) / 1.349 + 1 / step)
        if middle + deepest * below(n) <= entropy <= middle + perplexity.ABOVE * above(n):
            kept.append(r)
    return kept


def _plain_near_duplicates(rows):
    """Of rows whose fingerprints hang together, the one of smallest id."""
    prints = [simhash.fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return [r for r, g in zip(rows, group, strict=True) if r[0] == min(o[0] for o, h in zip(rows, group, strict=True) if h == g)]


def _plain_redaction(rows, spans):
    out = []
    for r in rows:
        at, parts = 0, []
        for s, k, e in spans[r[0]]:
            if s >= at:
                parts += [r[1][at:s], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        text = "".join([*parts, r[1][at:]])
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def test_stages_equal_plain_versions(spark):
    """Each stage on its predecessor's rows, against the same decisions taken row by row."""
    rng = random.Random(11)
    base = [prose(i, 40 + i % 60, pool=60) for i in range(70)]
    texts = base + [f"{base[i]} end{i}" for i in range(12)] + base[20:30]
    texts += [f"{prose(200 + i, 40, pool=60)} write to user{i}@example.com or +1 (212) 555-01{i:02d}" for i in range(12)]
    texts += ["".join(chr(rng.randrange(33, 90)) for _ in range(200)) + " q" * 12 for _ in range(4)] + ["short", "a b c d e " * 8]
    rows = [(i, t, "en" if i % 5 else "de", "abc"[i % 3], len(t)) for i, t in enumerate(texts)]
    stages = dict(corpus_pipeline.STAGES)
    table = lambda found: sorted(tuple(r) for r in found.collect())

    kept = table(stages["quality_rules"](spark, documents(spark, rows), ""))
    assert kept == sorted(_plain_quality(rows)) and len(kept) < len(rows)
    single = table(stages["simhash_near_dedup"](spark, documents(spark, kept), ""))
    assert single == sorted(_plain_near_duplicates(kept)) and len(single) < len(kept)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(documents(spark, single)).collect()}
    clean = table(stages["pii"](spark, documents(spark, single), ""))
    assert clean == sorted(_plain_redaction(single, spans)) and clean != single

    mixed = table(stages["source_mixing"](spark, documents(spark, clean), ""))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {s: sum(words(r[1]) for r in clean if r[3] == s) for s in "abc"}
    taken = {r.doc_id: r.taken for r in mixing.mix(documents(spark, clean)).collect()}
    for source, target in test_mixing._targets(sizes).items():
        assert abs(sum(words(r[1]) for r in mixed if r[3] == source) - target) <= 1
    for r in clean:
        copies = [m[1] for m in mixed if m[0] == r[0]]
        assert sum(map(words, copies)) == taken[r[0]] and all(r[1].startswith(c) for c in copies) and sum(c != r[1] for c in copies) <= 1

    packed = stages["packing"](spark, documents(spark, clean), "").collect()
    assert test_packing._check(clean, packed) <= 0.05 * sum(r.length for r in packed)
