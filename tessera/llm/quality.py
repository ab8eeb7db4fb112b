"""Operator 2: a quality classifier by factorisation machine.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): pairwise
interactions of rank ``RANK`` in time linear in a document's features. Features of a whole text:
its words hashed to ``BUCKETS`` slots (1 + log of the count, the row scaled to length one) and
``STATISTICS`` numbers of its structure and metadata (lengths, the stated n_chars against the text's
own, shares of capitals, digits, signs, line ends, repeated lines and words, ...), each as
piecewise-linear steps so that a linear machine can bend. Labels are the only other input, in
training; lang, source and doc_id never are.

How it runs: at most ``SAMPLE`` labelled rows, those of smallest hash of doc_id, are the training
rows (the documented bound; every row is scored). Their sparse features are written once. Each
round, ``SHARDS`` tasks start from the current parameters, pass their rows ``EPOCHS`` times with
AdaGrad, and return their parameters; the driver takes the mean of those bounded arrays (some 611 KB
each: two of 4,241 by 9 doubles). Scoring is one pass over the texts without a shuffle.

Defined cases: a null text is the empty text and is scored from its structure alone; a null n_chars
counts as the text's length; where no label is there to learn from, every score is 0.5; rows with
equal doc_id are scored by themselves and take any label of that doc_id in training; a row without
doc_id takes no part in training, is scored and not held out; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

BUCKETS, RANK, SEED = 4096, 8, 11
#: Training rows at most, tasks that share them, passes of a task in each round, and rounds.
SAMPLE, SHARDS, EPOCHS, ROUNDS = 20_000, 8, 4, 5
#: Rows of one AdaGrad step, learning rate and decay.
BATCH, RATE, DECAY = 24, 0.15, 1e-5
#: Score from which a text is predicted good.
CUT = 0.7
STATISTICS = 16
#: Rows scored together.
TOGETHER = 256
#: Steps of each statistic, which lies between 0 and 1.
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
WIDTH = STATISTICS * (len(STEPS) + 1)
FEATURES = BUCKETS + WIDTH

# Groups of ASCII characters.
_GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>{}\\^~=+@_", "mark": b".,;:!?", "loud": b"!?"}


def statistics(text: str, raw: bytes, words: list[bytes], stated: int | None) -> list[float]:
    """``STATISTICS`` numbers from 0 to 1."""
    n = max(1, len(raw))
    count = {k: (len(raw) - len(raw.translate(None, v))) / n for k, v in _GROUPS.items()}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    few = max(1, len(lines))
    each = max(1, len(words))
    short = sum(len(x) < 20 for x in lines) / few
    letters = (len(text) - (len(raw) - len(raw.translate(None, bytes(range(0x21, 0x41)))))) / max(1, len(text))
    length = len(text) if stated is None else max(0, stated)
    return [
        min(1.0, np.log1p(len(words)) / 10),
        min(1.0, np.log1p(len(text)) / 12),
        abs(length - len(text)) / max(1, length, len(text)),
        min(1.0, len(raw) / each / 20),
        count["upper"],
        count["digit"],
        min(1.0, 3 * count["symbol"]),
        min(1.0, 3 * count["mark"]),
        min(1.0, 3 * count["loud"]),
        max(0.0, letters),
        len(raw) / max(1, len(text)) - 1 if len(raw) < 2 * len(text) else 1.0,
        1 - len(set(lines)) / few if lines else 0.0,
        1 - len(set(words)) / each if words else 0.0,
        short,
        min(1.0, few / each),
        sum(map(raw.count, (b"http", b"{", b"();", b"|"))) / each if words else 0.0,
    ]


def features(text: str, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text; words come first, then the statistics' steps."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(BUCKETS)
    slots, counts = np.unique(hashed.astype(np.int32), return_counts=True)
    x = 1 + np.log(counts)
    if len(x):
        x /= np.sqrt((x * x).sum())
    s = np.clip(np.array(statistics(text, raw, words, stated)), 0, 1)
    edges = np.r_[0.0, STEPS, 1.0]
    bent = np.clip((s[:, None] - edges[:-1]) / np.diff(edges), 0, 1).ravel() / 4
    at = np.flatnonzero(bent)
    return np.r_[slots, BUCKETS + at].astype(np.int32), np.r_[x, bent[at]].astype(np.float32)


class Machine:
    """Parameters w0, w and v; each kept with its sum of squared gradients."""

    def __init__(self, state: np.ndarray | None = None):
        if state is None:
            rng = np.random.default_rng(SEED)
            state = np.zeros((2, FEATURES + 1, RANK + 1))
            state[0, :-1, 1:] = rng.normal(0, 0.05, (FEATURES, RANK))
            state[1] = 1e-3
        self.state = state

    def raw(self, slots: np.ndarray, x: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's sum of each of ``n`` rows, and the factor sums of each row."""
        own = self.state[0][slots]
        vx = own[:, 1:] * x[:, None]
        sums = np.zeros((n, RANK))
        bounds = np.searchsorted(row, np.arange(n))
        filled = np.diff(np.r_[bounds, len(row)]) > 0
        linear, squares = np.zeros(n), np.zeros(n)
        if filled.any():
            at = bounds[filled]
            sums[filled] = np.add.reduceat(vx, at)
            linear[filled] = np.add.reduceat(own[:, 0] * x, at)
            squares[filled] = np.add.reduceat((vx * vx).sum(axis=1), at)
        return self.state[0][-1, 0] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*_flat(rows))[0], -30, 30)))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """One AdaGrad step on the log loss."""
        slots, x, row, n = _flat(rows)
        total, sums = self.raw(slots, x, row, n)
        slope = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - labels) / n
        s = (slope[row] * x)[:, None]
        own = self.state[0][slots, 1:]
        used, place = np.unique(slots, return_inverse=True)
        each = np.concatenate([s, s * (sums[row] - own * x[:, None])], axis=1)
        grad = np.zeros((len(used) + 1, RANK + 1))
        np.add.at(grad, place, each)
        grad[-1, 0] = slope.sum()
        at = np.r_[used, FEATURES]
        grad += DECAY * self.state[0][at]
        self.state[1][at] += grad * grad
        self.state[0][at] -= RATE * grad / np.sqrt(self.state[1][at])


def _flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    sizes = np.fromiter((len(s) for s, _ in rows), np.int64, len(rows))
    none = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    slots, x = np.concatenate([s for s, _ in rows] or none[0]), np.concatenate([v for _, v in rows] or none[1]).astype(np.float64)
    return slots, x, np.repeat(np.arange(len(rows)), sizes), len(rows)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
        rows = [features(t, c) for t, c in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([s for s, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float32()))],
            ["doc_id", "label", "slots", "x"],
        )


def _round(state: np.ndarray, number: int):
    """One round of a shard: rows in, its parameters out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "label"])
        held = [(np.asarray(s), np.asarray(x)) for s, x in zip(rows["slots"], rows["x"], strict=True)]
        labels = rows["label"].to_numpy(np.float64)
        machine = Machine(state.copy())
        rng = np.random.default_rng([SEED, number, len(rows)])
        for _ in range(EPOCHS):
            order = rng.permutation(len(held))
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                machine.learn([held[j] for j in part], labels[part])
        return pd.DataFrame({"n": [len(rows)], "state": [machine.state.astype(np.float64).tobytes()]})

    return run


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Machine | None:
    """A machine from ``docs`` (doc_id, text, n_chars) and ``labelled`` (doc_id, label); None without labels.

    The labelled sample has at most ``sample`` rows, so it is broadcast."""
    known = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id")
    # One row of each doc_id, so a repeated one cannot outgrow the sample.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars")).alias("d"), F.max("label").alias("label")).select("doc_id", "d.text", "d.n_chars", "label")
    found = cut(rows.mapInArrow(_featured, "doc_id long, label int, slots array<int>, x array<float>").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))))
    machine = None
    for number in range(rounds):
        start = machine or Machine()
        made = found.groupBy("shard").applyInPandas(_round(start.state, number), "n long, state binary").orderBy("n", "state").collect()
        if not made:
            return None
        weight = np.array([r.n for r in made], np.float64)
        states = [np.frombuffer(r.state, np.float64).reshape(start.state.shape) for r in made]
        machine = Machine(sum(s * w for s, w in zip(states, weight, strict=True)) / weight.sum())
    return machine


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None if shared.value is None else Machine(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                rows = [features(t, c) for t, c in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist(), strict=True)]
                score = np.full(len(rows), 0.5) if machine is None else machine.score(rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(None if machine is None else machine.state)
    return docs.mapInArrow(_scored(shared), "doc_id long, score double")


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and n_chars: what the operator reads."""
    stated = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), stated.alias("n_chars"))


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, held_out, score and predicted of all documents."""
    docs = inputs(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    machine = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score_documents(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
