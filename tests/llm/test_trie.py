import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _ordered(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(x)] for c, x in own.items()}


def _rebuilt(rows):
    own = _ordered(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    return out


def brute_force(paths):
    """All nodes by definition."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = children.get(node, [])
        leaves[node] = sum(leaves[n] for n in own) if own else 1
        saved[node] = sum(saved[n] for n in own) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(paths[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(held), len(node), parent, len(held), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def _tables():
    rng = random.Random(3)
    said = ["", "yes", "no", "née \U0001f600", "a longer text of some words"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*said, None])) for c in [*range(0, 40), *range(180, 230), *range(-120, -90)] for t in range(rng.randint(1, 9))]
    # Copies of one conversation, prefixes of each other, ties and null turns, repeated rows, rows without an id, a long one.
    rows += [(c, t, "user", "same") for c in range(1000, 1040) for t in range(7)]
    rows += [(c, t, "user", f"step {t}") for c in range(2000, 2012) for t in range(c - 1998)]
    rows += [(3000, 1, "user", "b"), (3000, 1, "user", "a"), (3000, 1, "assistant", "z"), (3000, None, "user", "n"), (3000, None, "user", "n"), (3000, 1, "user", "a")]
    rows += [(None, 0, "user", "nobody")] * 3 + [(4000, t, "user", "x" * (t % 5)) for t in range(300)] + [(4001, t, "user", "x" * (t % 5)) for t in range(150)]
    return rows


@pytest.mark.parametrize("block", [8, trie.BLOCK])
def test_rebuilt_conversations(spark, block):
    rows = _tables()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("number", "depth", "k1", "block", "h", "n", "at", "ends", "first")})
    got = trie.trie(*trie.rebuilt_turns(df), block=block)
    assert _rows(got) == brute_force(_rebuilt(rows))


def test_plain_conversations_and_points(spark):
    rows = _tables()
    got = trie.trie(*trie.plain_turns(spark.createDataFrame(rows, SCHEMA)))
    want = brute_force(_ordered(rows))
    assert _rows(got) == want
    # Points are the nodes that branch, end or are leaves; the node below an edge is one.
    points = {(r.conv_id, r.depth) for r in got.where("depth = point_depth").collect()}
    nothing = hashlib.sha256().hexdigest()
    assert points == {(r[0], r[1]) for r in want if r[4] != 1 or r[7] != nothing or r[1] == 0}


def test_a_long_path_of_branches(spark):
    """Each conversation goes on where the last one ends, so the tree of paths is as high as there are conversations."""
    rows = [(c, t, "user", str(t)) for c in range(60) for t in range(60 - c)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert _rows(trie.trie(*trie.plain_turns(df))) == brute_force(_ordered(rows))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.trie(*trie.rebuilt_turns(empty)).count() == 0
    assert trie.trie(*trie.rebuilt_turns(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))).count() == 0


def test_query_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _rows(trie.query(spark, sf_dir)) == brute_force(_rebuilt(rows))
