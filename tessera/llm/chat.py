"""Operator 4: chat formatting in budgeted windows, in DataFrame and SQL functions only.

A conversation becomes one or more windows of at most ``BUDGET`` tokens. Prefix sums of turn tokens
choose the spans: with the room that the system turn and the history leave, a span takes turns as
long as the tokens since its start fit, so a window is full but for the turn that did not fit. Spans
are chosen inside parts of ``PART`` turns, so only the last span of a part may end early. A span
never exceeds the room unless one turn alone does, and spans are cut between turns only. Each window
holds the system turn (a first turn of that role), then turns before its span within ``HISTORY``
tokens, then its span. Assistant texts of the span are under the loss mask; repeated ones are not.

Template: ``<s>role[TEXT]text</s>`` and a line end for each turn. In roles and texts a backslash
follows each ``<`` and ``[``, so no control string can stand in a text; taking one backslash away
behind each of the two gives the text back exactly.

How it runs: turns are numbered and summed in blocks of ``BLOCK`` turn numbers, and one row per
block carries the sums from block to block, so a very long conversation is many tasks. A turn's
history is found by an equi-join on stretches of ``HISTORY`` tokens. Windows are
gathered by (conversation, span), a bounded group. Only the query's digests of whole conversations
bring the text of one conversation into one row, as their contract asks.

Defined cases: a null text or role is the empty one; rows of equal turn are ordered by role and
text, null turns come first, repeated rows are turns of their own; null conv_ids form one
conversation; a turn over the budget makes one window over the budget; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import same, table

#: Tokens of one window, of its repeated history at most, and of a turn's marks.
BUDGET, HISTORY, MARKS = 1024, 128, 4
#: The least room of a window's own turns, however long the system turn is.
LEAST = 64
#: Turn numbers summed in one group; turns that are put into spans together.
BLOCK, PART = 256, 256

# Control strings of the template.
BEGIN, TEXT, END = "<s>", "[TEXT]", "</s>\n"


def escaped(text):
    return F.regexp_replace(text, r"([<\[])", r"$1\\")


def unescaped(text):
    return F.regexp_replace(text, r"([<\[])\\", "$1")


def tokens(text):
    """Tokens of a turn: stretches of up to four characters inside words, and the marks."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]{1,4}")) + F.lit(MARKS)).cast("long")


def placed(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """All turns with their position, start (a prefix sum), span and whether they are the system turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / BLOCK))
    rows = rows.withColumn("tokens", tokens(F.col("text")))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.row_number().over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"), F.sum("tokens").over(order).alias("upto"))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), F.max(F.when(F.col("nth") == 1, F.when(F.col("role") == "system", F.col("tokens")).otherwise(0))).alias("lead"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"),
        F.first("lead").over(by_block).alias("system"),
    )
    rows = rows.join(blocks, same(F.col("conv_id"), F.col("_conv")) & same(F.col("block"), F.col("_block")))
    # The system turn stands outside the prefix sums.
    rows = rows.select(
        "conv_id",
        "role",
        "text",
        "tokens",
        (F.col("n_before") + F.col("nth")).alias("pos"),
        (F.col("sum_before") + F.col("upto") - F.col("tokens") - F.col("system")).alias("start"),
        F.greatest(F.lit(LEAST), F.lit(budget - history) - F.col("system")).alias("room"),
        ((F.col("system") > 0) & (F.col("n_before") + F.col("nth") == 1)).alias("is_system"),
        F.floor((F.col("n_before") + F.col("nth") - 1) / PART).alias("part"),
    )
    upto = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sizes", F.collect_list(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(upto))
    fits = "aggregate(sizes, named_struct('sum', 0L, 'nth', 0L), (a, t) -> if(a.sum > 0 and a.sum + t > room, named_struct('sum', t, 'nth', a.nth + 1), named_struct('sum', a.sum + t, 'nth', a.nth)), a -> a.nth)"
    return rows.withColumn("span", F.col("part") * (PART + 1) + F.expr(fits)).drop("sizes", "part", "room")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_turns, n_repeated, tokens and loss (array of struct s, e) of each window.

    ``window`` rises inside a conversation, with gaps. The first ``n_repeated`` turns of a window
    stand in earlier ones already. ``loss`` has code points of ``formatted``, the end exclusive.
    """
    rows = placed(conversations, budget, history).select(
        "*", F.concat(F.lit(BEGIN), escaped(F.col("role")), F.lit(TEXT)).alias("head"), escaped(F.col("text")).alias("body")
    )
    rows = rows.select("conv_id", "pos", "start", "tokens", "span", "is_system", "head", "body", (F.col("role") == "assistant").alias("learns"))
    turns = rows.where(~F.col("is_system"))
    own = rows.select("conv_id", F.col("span").alias("window"), "pos", "head", "body", "tokens", "learns", F.lit(False).alias("repeated"))
    spans = turns.groupBy("conv_id", "span").agg(F.min("start").alias("first")).select(F.col("conv_id").alias("_conv"), F.col("span").alias("window"), "first")
    # A turn within the history before a span starts in the span's stretch of that many tokens, or in the one before.
    stretch = F.floor(F.col("first") / history)
    asking = spans.withColumn("_stretch", F.explode(F.array(stretch - 1, stretch)))
    earlier = turns.withColumn("stretch", F.floor(F.col("start") / history)).join(asking, same(F.col("conv_id"), F.col("_conv")) & (F.col("stretch") == F.col("_stretch")))
    earlier = earlier.where((F.col("first") > F.col("start")) & (F.col("first") - F.col("start") <= history))
    earlier = earlier.select("conv_id", "window", "pos", "head", "body", "tokens", F.lit(False).alias("learns"), F.lit(True).alias("repeated"))
    system = rows.where("is_system").select(F.col("conv_id").alias("_system"), "pos", "head", "body", "tokens")
    retained = spans.where("window > 0").join(system, same(F.col("_conv"), F.col("_system")))
    retained = retained.select(F.col("_conv").alias("conv_id"), "window", "pos", "head", "body", "tokens", F.lit(False).alias("learns"), F.lit(True).alias("repeated"))
    every = own.unionByName(earlier).unionByName(retained)
    grouped = every.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "head", "body", "learns"))).alias("turns"),
        F.count("*").alias("n_turns"),
        F.count_if("repeated").alias("n_repeated"),
        F.sum("tokens").alias("tokens"),
    )
    step = "named_struct('at', acc.at + length(t.head) + length(t.body) + {0}, 'loss', if(t.learns, concat(acc.loss, array(named_struct('s', acc.at + length(t.head), 'e', acc.at + length(t.head) + length(t.body)))), acc.loss))"
    loss = f"aggregate(turns, named_struct('at', 0, 'loss', cast(array() as array<struct<s:int,e:int>>)), (acc, t) -> {step.format(len(END))}, acc -> acc.loss)"
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), "")
    return grouped.select("conv_id", "window", formatted.alias("formatted"), "n_turns", "n_repeated", "tokens", F.expr(loss).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of struct role, text) and learned (texts under the loss mask), each turn once."""
    pieces = F.split("formatted", F.lit(END), -1)
    fresh = F.slice(pieces, F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))

    def turn(piece):
        cut_at = F.instr(piece, TEXT)
        return F.struct(
            unescaped(F.substring(piece, F.lit(len(BEGIN) + 1), cut_at - F.lit(len(BEGIN) + 1))).alias("role"),
            unescaped(F.substring(piece, cut_at + F.lit(len(TEXT)), F.length(piece))).alias("text"),
        )

    learned = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), x.s + 1, x.e - x.s)))
    return formatted.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("n_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from windows."""
    back = read_back(formatted).select(
        "conv_id",
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"),
        F.array_join("learned", "").alias("learned"),
        "n_chars",
    )
    whole = back.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "turns", "learned"))).alias("parts"), F.sum("n_chars").alias("formatted_chars")
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("parts.turns", ""), 256).alias("turns_sha256"),
        F.length(F.array_join("parts.learned", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("parts.learned", ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the contract adds.
EXTRA = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: digests of all conversations and of one whose texts are control strings."""
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return digests(windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)))


ORACLE_SQL = r"""
WITH RECURSIVE said AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
counted AS (
  SELECT *, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]{1,4}')) + 4 AS BIGINT) AS tokens,
         row_number() OVER w AS pos,
         length(regexp_replace(role, '([<\[])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[])', '\1\\', 'g')) + 14 AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
led AS (
  SELECT *, coalesce(max(CASE WHEN pos = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS system,
         sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS upto
  FROM counted),
started AS (
  SELECT *, upto - tokens - system AS start, greatest(64, 896 - system) AS room, pos = 1 AND system > 0 AS is_system,
         CASE WHEN pos = 1 AND system > 0 THEN 0 ELSE tokens END AS own
  FROM led),
chosen AS (
  SELECT conv_id, pos, own AS held, 0 AS nth FROM started WHERE (pos - 1) % 256 = 0
  UNION ALL
  SELECT s.conv_id, s.pos, CASE WHEN held > 0 AND held + own > room THEN own ELSE held + own END, nth + CASE WHEN held > 0 AND held + own > room THEN 1 ELSE 0 END
  FROM chosen c JOIN started s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.pos = c.pos + 1 AND (s.pos - 1) % 256 <> 0),
placed AS (
  SELECT s.*, (s.pos - 1) // 256 * 257 + nth AS span FROM started s JOIN chosen c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.pos = c.pos),
spans AS (SELECT conv_id, span, min(start) AS first FROM placed WHERE NOT is_system GROUP BY conv_id, span),
every AS (
  SELECT conv_id, chars FROM placed
  UNION ALL
  SELECT p.conv_id, p.chars FROM placed p JOIN spans s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
    AND NOT p.is_system AND s.first > p.start AND s.first - p.start <= 128
  UNION ALL
  SELECT p.conv_id, p.chars FROM placed p JOIN spans s ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.is_system AND s.span > 0),
sizes AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM every GROUP BY conv_id),
wholes AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '') AS learned
  FROM placed GROUP BY conv_id)
SELECT w.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars
FROM wholes w JOIN sizes s ON w.conv_id IS NOT DISTINCT FROM s.conv_id
"""
