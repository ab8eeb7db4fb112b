"""Queries over ledgers: events, orders, reviews and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import ledger
from tessera.plans.registry import query
from tessera.sources.domain import table


@query("latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS versions FROM events GROUP BY user_id")
def latest_state(spark, sf):
    """The last event of each user."""
    return ledger.latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "event_id"])


@query("idempotent_append", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def idempotent_append(spark, sf):
    """Only the first event of each key is kept."""
    return ledger.first_only(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"], ["event_id"])


@query("confirmed_state", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'confirm' ELSE 'candidate' END AS action, event_type FROM events),
f AS (SELECT user_id, min(event_id) AS confirmed FROM e WHERE action = 'confirm' GROUP BY 1)
SELECT e.user_id, CASE WHEN min(confirmed) IS NULL THEN 'candidate' ELSE 'confirmed' END AS status, arg_max(event_type, event_id) FILTER (confirmed IS NULL OR event_id < confirmed) AS event_type
FROM e LEFT JOIN f USING (user_id) WHERE action = 'candidate' GROUP BY e.user_id HAVING count(*) FILTER (confirmed IS NULL OR event_id < confirmed) > 0""")
def confirmed_state(spark, sf):
    """T4: a confirmed value is never overwritten by a later candidate."""
    e = table(spark, sf, "events").withColumn("action", F.when(F.col("event_type") == "purchase", "confirm").otherwise("candidate"))
    return ledger.confirmed_state(e, "user_id", ["event_id"], "action", "event_type")


@query("page_growth", "SELECT event_id, event_type, (SELECT count(*) FROM events WHERE user_id = 7) AS total, true AS has_more FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 5 OFFSET 5")
def page_growth(spark, sf):
    """K5: the second page of a user's events, newest first."""
    own = table(spark, sf, "events").where("user_id = 7")
    return ledger.page(own, [F.desc("ts"), F.desc("event_id")], 5, 5).select("event_id", "event_type", "total", "has_more")


@query("state_fingerprint", "SELECT o_custkey, n, sha1(items) AS fingerprint FROM (SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderpriority || '|' || o_orderstatus, chr(10) ORDER BY o_orderpriority || '|' || o_orderstatus) AS items FROM orders GROUP BY 1)")
def state_fingerprint(spark, sf):
    """A digest of each profile's sorted facts."""
    return ledger.fingerprint(table(spark, sf, "orders"), "o_custkey", F.concat_ws("|", "o_orderpriority", "o_orderstatus"))


@query("content_changes", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before IS NULL OR before <> o_orderpriority")
def content_changes(spark, sf):
    """Events that change the value."""
    return ledger.changed(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderpriority")).select("o_orderkey", "o_orderpriority")


@query("review_gate", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'PENDING' WHEN quality = 1 AND toxic = 0 THEN 'APPROVED' WHEN quality = 1 THEN 'WAIVED' ELSE 'REJECTED' END AS gate FROM documents d LEFT JOIN labels l USING (doc_id)")
def review_gate(spark, sf):
    """Decisions over facts, in order of precedence."""
    gate = F.when(F.col("quality").isNull(), "PENDING").when((F.col("quality") == 1) & (F.col("toxic") == 0), "APPROVED").when(F.col("quality") == 1, "WAIVED").otherwise("REJECTED")
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", gate.alias("gate"))


@query("chat_history_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6")
def chat_history_window(spark, sf):
    """The last six turns, in order."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf, "conversations").withColumn("back", back).where("back <= 6").select("conv_id", "turn", "role")


@query("recency_score", "SELECT event_id, floor(greatest(0.2::DOUBLE, 1.0::DOUBLE - 0.5::DOUBLE * greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts))) / 86400.0::DOUBLE) / 30.0::DOUBLE) * 10000 + 0.5) / 10000 AS score FROM events")
def recency_score(spark, sf):
    """Decay with age against a stated now."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", T.half_up(T.recency("ts", now), 4).alias("score"))


@query("candidates_from_events", "SELECT event_id, kind, event_type || ':' || kind AS title FROM events CROSS JOIN (SELECT unnest(['skill', 'interest']) AS kind) WHERE event_type IN ('purchase', 'signup')")
def candidates_from_events(spark, sf):
    """Each event of two types gives two candidates."""
    kinds = F.explode(F.array(F.lit("skill"), F.lit("interest"))).alias("kind")
    return table(spark, sf, "events").where("event_type in ('purchase', 'signup')").select("event_id", "event_type", kinds).select("event_id", "kind", F.concat_ws(":", "event_type", "kind").alias("title"))


@query("delete_unconfirmed", "SELECT event_id FROM events e WHERE NOT (event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase'))")
def delete_unconfirmed(spark, sf):
    """T5: delete what nobody confirmed."""
    events = table(spark, sf, "events")
    sure = events.where("event_type = 'purchase'").select("user_id").distinct()
    gone = events.where("event_type = 'error'").join(sure, "user_id", "left_anti").select("event_id")
    return events.select("event_id").join(gone, "event_id", "left_anti")


@query("append_if_absent", "SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def append_if_absent(spark, sf):
    """Rows whose key is not there yet."""
    old = table(spark, sf, "labels").select("doc_id")
    return old.withColumn("origin", F.lit("label")).union(table(spark, sf, "documents").select("doc_id").join(old, "doc_id", "left_anti").withColumn("origin", F.lit("new")))


@query("unexpired_sessions", "SELECT user_id, max(ts) + INTERVAL 7 DAY > TIMESTAMP '2024-01-31 00:00:00' AS valid FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1")
def unexpired_sessions(spark, sf):
    """Sessions that have not run out at a stated time."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return table(spark, sf, "events").where(F.col("ts") < now).groupBy("user_id").agg((F.max("ts") + F.expr("interval 7 days") > now).alias("valid"))


@query("session_states", """
WITH e AS (SELECT user_id AS key, event_id AS request, ts AS at, CASE WHEN event_type = 'purchase' THEN 'confirm' ELSE 'candidate' END AS action, event_type AS value FROM events),
n AS (SELECT *, CASE WHEN at_ - lag(at_) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM (SELECT * RENAME (at AS at_) FROM e) WINDOW w AS (PARTITION BY key ORDER BY at_, request)),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY at_, request ROWS UNBOUNDED PRECEDING) AS session FROM n),
c AS (SELECT *, min((at_, request)) FILTER (action = 'confirm') OVER (PARTITION BY key, session) AS confirmed FROM s)
SELECT key, min(at_) AS start, max(at_) + INTERVAL 12 HOUR AS "end", count(*) AS requests, CASE WHEN count(confirmed) > 0 THEN 'confirmed' ELSE 'candidate' END AS status,
  arg_max(value, (at_, request)) FILTER (action = 'candidate' AND (confirmed IS NULL OR (at_, request) < confirmed)) AS value FROM c GROUP BY key, session""".replace(" AS at, CASE", " AS at_, CASE").replace("(SELECT * RENAME (at AS at_) FROM e)", "e"))
def session_states(spark, sf):
    """Each session of a user: requests once, the value that stays, and when it ends."""
    action = F.when(F.col("event_type") == "purchase", "confirm").otherwise("candidate")
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("request"), F.col("ts").alias("at"), action.alias("action"), F.col("event_type").alias("value"))
    return ledger.session_states(events, "12 hours")


@query("memory_recall", """
WITH words AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*')) AS term FROM conversations WHERE role = 'user' AND conv_id % 50 = 0),
memory AS (SELECT DISTINCT conv_id AS memory, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*')) AS term FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, memory, count(*) AS score FROM words JOIN memory USING (term) WHERE conv_id <> memory AND length(term) >= 4 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, memory) AS rank FROM c) WHERE rank <= 3""")
def memory_recall(spark, sf):
    """Memories that share most words with what was said; the conversations divisible by 50 ask all."""
    said = table(spark, sf, "conversations")
    words = said.where("role = 'user' and conv_id % 50 = 0").select("conv_id", F.explode(T.latin_tokens("text")).alias("term")).distinct()
    memory = said.where("role = 'assistant'").select(F.col("conv_id").alias("memory"), F.explode(T.latin_tokens("text")).alias("term")).distinct()
    c = words.where(F.length("term") >= 4).join(memory, "term").where("conv_id <> memory").groupBy("conv_id", "memory").agg(F.count("*").alias("score"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "memory"))).where("rank <= 3")


@query("event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def event_props(spark, sf):
    """Tolerant JSON: a field, or null where the text is not JSON."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL")
def hourly_events(spark, sf):
    """Tumbling windows (a Spark extra)."""
    per = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), T.half_up(F.sum("value"), 2).alias("total"))
    return per.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("user_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def user_sessions(spark, sf):
    """Session windows (a Spark extra)."""
    return ledger.sessions(table(spark, sf, "events"), "user_id", "ts", "30 minutes")


@query("as_of_join", """
SELECT p.event_id, (SELECT arg_max(v.value, v.ts) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts) AS seen FROM events p WHERE p.event_type = 'purchase'""")
def as_of_join(spark, sf):
    """As-of join (a Spark extra): the last view at or before each purchase."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    return ledger.as_of(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "seen").select("event_id", "seen")
