import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality
from tests.llm.helpers import ODD, documents, prose


def _labelled():
    good = [(i, prose(i, 80), "en", "a", 0) for i in range(120)]
    junk = [(200 + i, "".join(w + "$$$ " for w in prose(i, 60).split()), "en", "a", 0) for i in range(60)]
    return good + junk


def test_linear_time_identity():
    machine = quality.Machine()
    machine.state[0] = np.random.default_rng(1).normal(0, 0.3, machine.state[0].shape)
    rows = [quality.features(t, None) for t in ("a few words a few", "", "x " * 50, "### $$ 12")]
    got = machine.raw(*quality._flat(rows))[0]
    for (slots, x), value in zip(rows, got, strict=True):
        w, v = machine.state[0][slots, 0], machine.state[0][slots, 1:]
        pairs = sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert abs(machine.state[0][-1, 0] + float(w @ x) + pairs - value) < 1e-6


def test_learns_and_scores_all_rows(spark):
    rows = _labelled()
    docs = quality.inputs(documents(spark, rows + [(500 + i if r[0] else None, *r[1:]) for i, r in enumerate(ODD)], extra=True))
    labels = spark.createDataFrame([(r[0], int(r[0] < 200)) for r in rows] + [(None, 1), (7777, None)], "doc_id long, label int")
    machine = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))), rounds=3)
    found = quality.score_documents(docs, machine).collect()
    assert len(found) == len(rows) + len(ODD)
    assert all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.7) == (r.doc_id < 200) for r in held]) > 0.95


def test_query_on_held_out_labels(spark, sf_dir):
    found = quality.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.85


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality.train(quality.inputs(documents(spark, ODD)), none) is None
    assert {r.score for r in quality.score_documents(quality.inputs(documents(spark, ODD)), None).collect()} == {0.5}
    assert quality.score_documents(quality.inputs(documents(spark, [])), None).count() == 0


def _plain_step(params, squares, rows, labels):
    """One AdaGrad step with loops over slots, from the gradient of the pairwise sum."""
    k = quality.RANK
    grad = {}
    for (slots, x), y in zip(rows, labels, strict=True):
        x = [float(v) for v in x]
        raw = params["w0"] + sum(params[i, 0] * v for i, v in zip(slots, x, strict=True))
        raw += sum(params[slots[a], f] * params[slots[b], f] * x[a] * x[b] for a in range(len(x)) for b in range(a) for f in range(1, k + 1))
        slope = (1 / (1 + np.exp(-raw)) - y) / len(rows)
        grad["w0"] = grad.get("w0", 0.0) + slope
        for a, i in enumerate(slots):
            grad[i, 0] = grad.get((i, 0), 0.0) + slope * x[a]
            for f in range(1, k + 1):
                others = sum(params[slots[b], f] * x[b] for b in range(len(x)) if b != a)
                grad[i, f] = grad.get((i, f), 0.0) + slope * x[a] * others
    for key, g in grad.items():
        g += quality.DECAY * params[key]
        squares[key] += g * g
        params[key] -= quality.RATE * g / np.sqrt(squares[key])


def test_training_equals_a_plain_version(spark):
    """All rounds over all shards, against plain loops over rows, slots and factors."""
    rows = [(i, prose(i, 3, pool=12), "en", "a", 20) for i in range(40)]
    docs = quality.inputs(documents(spark, rows))
    labels = {i: int(i % 3 > 0) for i in range(40)}
    machine = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, label int"), rounds=2)
    shard = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.SHARDS)).alias("s")).collect()}
    features = {r[0]: (lambda f: (f[0].tolist(), f[1].tolist()))(quality.features(r[1], r[4])) for r in rows}
    first = quality.Machine().state
    keys = ["w0", *[(i, f) for i in {i for s, _ in features.values() for i in s} for f in range(quality.RANK + 1)]]
    at = lambda key: (-1, 0) if key == "w0" else key
    params, squares = ({k: float(first[n][at(k)]) for k in keys} for n in (0, 1))
    for number in range(2):
        made = []
        for s in sorted(set(shard.values())):
            own = sorted(i for i in shard if shard[i] == s)
            p, q = dict(params), dict(squares)
            rng = np.random.default_rng([quality.SEED, number, len(own)])
            for _ in range(quality.EPOCHS):
                order = rng.permutation(len(own))
                for i in range(0, len(order), quality.BATCH):
                    part = [own[j] for j in order[i : i + quality.BATCH]]
                    _plain_step(p, q, [features[d] for d in part], [labels[d] for d in part])
            made.append((len(own), p, q))
        params, squares = ({k: sum(n * m[side][k] for n, *m in made) / len(rows) for k in keys} for side in (0, 1))
    assert max(abs(machine.state[0][at(k)] - params[k]) for k in keys) < 1e-6
