"""Sessions on a stream against the batch operator over the same events."""

import datetime as dt
import random

from tessera.operators import ledger
from tessera.streaming import stateful

SCHEMA = "key long, request long, at timestamp, action string, value string"
START = dt.datetime(2024, 1, 1)


def _events():
    rng = random.Random(2)
    rows, request = [], 0
    for key in range(4):
        minute = 0
        for _ in range(14):
            minute += rng.choice([3, 8, 20, 45, 90])
            request += 1
            action = "confirm" if rng.random() < 0.2 else "candidate"
            rows.append((key, request, START + dt.timedelta(minutes=minute), action, f"v{request}"))
    return rows


def test_sessions_on_a_stream_equal_the_batch(spark, tmp_path):
    before = spark.conf.get(stateful.PROVIDER[0], None)
    spark.conf.set(*stateful.PROVIDER)
    try:
        rows = _events()
        rng = random.Random(3)
        # By time, but each event up to ten places early or late, and some requests sent again in a later file.
        order = sorted(range(len(rows)), key=lambda i: (rows[i][2] - START).total_seconds() / 60 + rng.uniform(0, 15))
        parts = [[rows[i] for i in order[k::1][:12]] for k in range(0, len(order), 12)]
        for n, part in enumerate(parts[1:], 1):
            part += rng.sample(parts[n - 1], 3)
        end = START + dt.timedelta(days=5)
        parts += [[(99, 9000, end, "candidate", "far")], [(99, 9001, end + dt.timedelta(days=1), "candidate", "later")]]
        # Too late: behind the watermark that the far event has set.
        parts += [[(0, 9002, START, "confirm", "late"), (99, 9003, end + dt.timedelta(days=3), "candidate", "last")]]
        for n, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{n:03d}"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = []
        found = stateful.session_states(stream, "30 minutes", "40 minutes")
        found.writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        want = [tuple(r) for r in ledger.session_states(spark.createDataFrame(rows, SCHEMA), "30 minutes").select("key", "start", "end", "requests", "status", "value").collect()]
        assert sorted(r for r in out if r[0] != 99) == sorted(want) and len(want) > 8
        assert [r[5] for r in sorted(out) if r[0] == 99][:1] == ["far"]
        assert {r[4] for r in want} == {"candidate", "confirmed"}
    finally:
        spark.conf.set(stateful.PROVIDER[0], before) if before else spark.conf.unset(stateful.PROVIDER[0])
