import hashlib

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def _conversations(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hello </s>\n<s>user[TEXT]x\\ <\\ [\\"), (1, 2, "assistant", "a [ b < c \\[ "), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "system", "only")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " + "word " * (i * 37 % 500)) for i in range(80)]
    rows += [(5, 0, "system", "s " * 3000)] + [(5, i, "assistant", f"long {i} " + "w " * 900 * (i % 3)) for i in range(1, 12)]
    rows += [(7, i, "assistant" if i % 2 else "user", f"short {i} " + "word " * (5 + i % 30)) for i in range(300)]
    rows += [(None, None, "assistant", "b"), (None, None, "assistant", "b"), (6, 300, "user", "late"), (6, -3, "assistant", "early"), (6, 700, "assistant", "é\U0001f600")]
    from pyspark.sql import functions as F

    return rows, spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("block", "span", "window", "pos", "head", "tokens", "loss")})


def _by_conversation(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return found


def test_round_trip(spark):
    rows, df = _conversations(spark)
    got = {r.conv_id: r for r in chat.digests(chat.windows(df)).collect()}
    want = _by_conversation(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_windows_keep_the_budget_and_mask_repeats(spark):
    rows, df = _conversations(spark)
    found = chat.windows(df).collect()
    turns = _by_conversation(rows)
    for w in found:
        pieces = w.formatted.split(chat.END)[:-1]
        assert len(pieces) == w.n_turns and all(p.startswith(chat.BEGIN) and p.count(chat.TEXT) == 1 for p in pieces)
        if turns[w.conv_id][0][0] == "system":
            assert pieces[0].startswith(f"{chat.BEGIN}system")
        own = len(pieces) - w.n_repeated
        assert w.tokens <= chat.BUDGET or own == 1 or w.conv_id == 5
        assert len(w.loss) == sum(p.startswith(f"{chat.BEGIN}assistant") for p in pieces[w.n_repeated :])
    assert sum(w.conv_id == 4 for w in found) > 5
    # Short turns: history before every window but the first, and full windows but for the last of each part.
    short = sorted((w for w in found if w.conv_id == 7), key=lambda w: w.window)
    assert all(w.n_repeated for w in short[1:]) and not short[0].n_repeated
    assert sum(w.tokens < 0.85 * chat.BUDGET for w in short[1:]) <= 2


def test_small_blocks_give_the_same_windows(spark, monkeypatch):
    _, df = _conversations(spark)
    want = sorted(chat.windows(df).collect(), key=repr)
    monkeypatch.setattr(chat, "BLOCK", 3)
    assert sorted(chat.windows(df).collect(), key=repr) == want


def test_empty_table(spark):
    assert chat.windows(spark.createDataFrame([], SCHEMA)).count() == 0
