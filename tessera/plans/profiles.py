"""Queries of recommendation, memory and review in full: indices, plans, triggers, decisions, views and contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph
from tessera.plans.checks import check
from tessera.plans.recommend import _COVERED, _GAP, _askers, _best, _needs, _scores, _targets, _weighted
from tessera.plans.registry import query
from tessera.sources import domain
from tessera.sources.domain import ctes, table


@query("category_scores", """
WITH c AS (SELECT l_suppkey AS subject, l_linestatus || l_returnflag AS category, count(*) AS n, CAST(sum(floor(l_discount * 100 + 0.5)) AS BIGINT) AS points FROM lineitem GROUP BY ALL),
m AS (SELECT *, floor(points / n::DOUBLE * 100 + 0.5) / 100 AS mean FROM c)
SELECT subject, count(*) AS categories, floor(sum(points) / sum(n)::DOUBLE * 100 + 0.5) / 100 AS overall, arg_min(category, (-mean, category)) AS best, arg_min(category, (mean, category)) AS worst FROM m GROUP BY subject""")
def category_scores(spark, sf):
    """Averages by category, the overall one, the best and the worst category."""
    points = F.floor(F.col("l_discount") * 100 + 0.5)
    per = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.concat("l_linestatus", "l_returnflag").alias("category")).agg(F.count("*").alias("n"), F.sum(points).alias("points"))
    per = per.withColumn("mean", T.half_up(F.col("points") / F.col("n"), 2))
    return per.groupBy("subject").agg(F.count("*").alias("categories"), T.half_up(F.sum("points") / F.sum("n"), 2).alias("overall"), F.min_by("category", F.struct((-F.col("mean")).alias("m"), "category")).alias("best"), F.min_by("category", F.struct("mean", "category")).alias("worst"))


#: Weights of the six metrics, and the least index of each grade.
INDEX_WEIGHTS = {"coverage": 30, "breadth": 20, "domains": 15, "done": 15, "means": 10, "pace": 10}
GRADES = (("A", 60), ("B", 45), ("C", 30))


@query("career_index", ctes("requires", "owned", body=_COVERED + """,
best AS (SELECT profile, max(score) AS coverage FROM scores GROUP BY profile),
breadth AS (SELECT profile, least(1.0::DOUBLE, count(*) / 60.0::DOUBLE) AS breadth, least(1.0::DOUBLE, count(DISTINCT p_brand) / 25.0::DOUBLE) AS domains FROM owned JOIN part ON p_partkey = skill GROUP BY profile),
orders_ AS (SELECT o_custkey AS profile, count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE AS done, least(1.0::DOUBLE, count(*) / 20.0::DOUBLE) AS pace FROM orders GROUP BY 1),
i AS (SELECT profile, floor(30::DOUBLE * coverage + 20::DOUBLE * breadth + 15::DOUBLE * domains + 15::DOUBLE * done + 10::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 10000)) + 10::DOUBLE * pace + 0.5) AS idx FROM best JOIN breadth USING (profile) JOIN orders_ USING (profile) JOIN customer ON c_custkey = profile)
SELECT profile, idx AS index_, CASE WHEN idx >= 60 THEN 'A' WHEN idx >= 45 THEN 'B' WHEN idx >= 30 THEN 'C' ELSE 'D' END AS grade FROM i"""))
def career_index(spark, sf):
    """Six metrics weighted into an index, and its grade."""
    one = F.lit(1.0)
    best = _scores(spark, sf).groupBy("profile").agg(F.max("score").alias("coverage"))
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("skill"), "p_brand")
    breadth = domain.owned(spark, sf).join(brands, "skill").groupBy("profile").agg(F.least(one, F.count("*") / 60.0).alias("breadth"), F.least(one, F.countDistinct("p_brand") / 25.0).alias("domains"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("profile")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("done"), F.least(one, F.count("*") / 20.0).alias("pace"))
    means = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile"), F.greatest(F.lit(0.0), F.least(one, F.col("c_acctbal") / 10000)).alias("means"))
    joined = best.join(breadth, "profile").join(orders, "profile").join(means, "profile")
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * F.col(m) for m, w in INDEX_WEIGHTS.items()])
    found = joined.select("profile", F.floor(total + 0.5).cast("double").alias("index_"))
    grade = reduce(lambda c, g: c.when(F.col("index_") >= g[1], g[0]), GRADES[1:], F.when(F.col("index_") >= GRADES[0][1], GRADES[0][0])).otherwise("D")
    return found.withColumn("grade", grade)


@query("gap_effort", _GAP + """,
w AS (SELECT occupation, skill, floor(importance * 1000 + 0.5) AS w, target_level FROM requires),
s AS (SELECT t.profile, w.w, w.target_level, CASE WHEN g.skill IS NULL THEN 'owned' WHEN w.target_level >= 2 THEN 'missing' ELSE 'optional' END AS status FROM target t JOIN w USING (occupation) LEFT JOIN gap g ON g.profile = t.profile AND g.skill = w.skill)
SELECT profile, status, count(*) AS skills, CAST(sum(w * target_level) AS BIGINT) AS effort FROM s GROUP BY ALL""")
def gap_effort(spark, sf):
    """Skills by status, and the importance times level that each status stands for."""
    asked = _targets(spark, sf).join(_weighted(spark, sf), "occupation")
    have = domain.owned(spark, sf).withColumn("have", F.lit(1))
    status = F.when(F.col("have") == 1, "owned").when(F.col("target_level") >= 2, "missing").otherwise("optional")
    rows = asked.join(have, ["profile", "skill"], "left").select("profile", status.alias("status"), "w", "target_level")
    return rows.groupBy("profile", "status").agg(F.count("*").alias("skills"), F.sum(F.col("w") * F.col("target_level")).cast("long").alias("effort"))


_NEXT = ", following AS (SELECT * FROM (SELECT s_suppkey AS src, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dst FROM supplier) WHERE dst IS NOT NULL)"


@query("skill_gap_tool", _GAP + _NEXT + """,
g AS (SELECT gap.profile, gap.skill, depth, p_type FROM gap JOIN d USING (skill) JOIN part ON p_partkey = gap.skill),
o AS (SELECT profile, skill, depth, row_number() OVER (PARTITION BY profile ORDER BY depth, skill) AS step FROM g),
r AS (SELECT profile, count(*) AS required FROM direct GROUP BY profile),
h AS (SELECT d.profile, count(*) AS owned FROM direct d JOIN owned o ON o.profile = d.profile AND o.skill = d.skill GROUP BY d.profile)
SELECT r.profile, required, coalesce(h.owned, 0) AS owned, string_agg(CASE WHEN step <= 3 THEN CAST(o.skill AS VARCHAR) END, ',' ORDER BY step) AS first_steps,
  (SELECT string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM g WHERE g.profile = r.profile) AS tools, (SELECT min(dst) FROM following JOIN target ON src = occupation WHERE target.profile = r.profile) AS next_role
FROM r LEFT JOIN h USING (profile) LEFT JOIN o USING (profile) GROUP BY r.profile, required, h.owned""")
def skill_gap_tool(spark, sf):
    """M7: required and owned skills, the first steps, the tools of what is missing and the next role."""
    direct = domain.requires(spark, sf).groupBy("occupation").agg(F.count("*").alias("required"), F.collect_list("skill").alias("direct"))
    lists = _needs(spark, sf, "p_type").groupBy("occupation", "depth", "p_type").agg(F.array_sort(F.collect_list("skill")).alias("skills"))
    lists = lists.groupBy("occupation").agg(F.collect_list(F.struct("depth", "p_type", "skills")).alias("lists"))
    following = domain.transitions(spark, sf).groupBy(F.col("src").alias("occupation")).agg(F.min("dst").alias("next_role"))
    rows = _askers(spark, sf).join(direct, "occupation").join(lists, "occupation", "left").join(following, "occupation", "left")
    # Of each depth and type, three skills in order are enough for the first three of all.
    lacked = F.transform("lists", lambda x: F.struct(x.depth.alias("depth"), x.p_type.alias("p_type"), F.slice(F.array_except(x.skills, F.col("have")), 1, 3).alias("first")))
    rows = rows.select("profile", "required", F.size(F.array_intersect("direct", "have")).cast("long").alias("owned"), F.filter(lacked, lambda x: F.size(x.first) > 0).alias("lacked"), "next_role")
    first = F.slice(F.array_sort(F.flatten(F.transform("lacked", lambda x: F.transform(x.first, lambda s: F.struct(x.depth.alias("depth"), s.alias("skill")))))), 1, 3)
    some, known = F.col("profile").isNotNull() & (F.size("lacked") > 0), F.col("profile").isNotNull()
    steps, tools = F.array_join(F.transform(first, lambda x: x.skill.cast("string")), ","), F.array_join(F.array_sort(F.array_distinct(F.col("lacked.p_type"))), ",")
    return rows.select("profile", "required", "owned", F.when(some, steps).alias("first_steps"), F.when(some, tools).alias("tools"), F.when(known, F.col("next_role")).alias("next_role"))


@query("path_plan", _GAP + """,
w AS (SELECT t.profile, skill, max(floor(importance * 1000 + 0.5)) AS priority FROM target t JOIN requires USING (occupation) GROUP BY ALL),
p AS (SELECT g.profile, g.skill, CAST(least(3, depth // 2 + 1) AS INTEGER) AS stage, CAST(coalesce(priority, 0) AS BIGINT) AS priority, 8 + 4 * (g.skill % 5) AS hours FROM gap g JOIN d USING (skill) LEFT JOIN w ON w.profile = g.profile AND w.skill = g.skill)
SELECT profile, stage, count(*) AS skills, CAST(sum(hours) AS BIGINT) AS hours, CAST(ceil(sum(hours) / 10.0) AS BIGINT) AS weeks, max(priority) AS top_priority, arg_min(skill, (-priority, skill)) AS first_skill FROM p GROUP BY ALL""")
def path_plan(spark, sf):
    """M4: missing skills with priority and stage; each stage's hours, weeks and first skill."""
    hours = 8 + 4 * (F.col("skill") % 5)
    own = F.struct((-F.coalesce("priority", F.lit(0)).cast("long")).alias("first"), "skill")
    lists = _needs(spark, sf).groupBy("occupation", "depth").agg(F.array_sort(F.collect_list(own)).alias("items"), F.sum(hours).alias("hours")).select("occupation", "depth", F.col("items.skill").alias("skills"), F.col("items.first").alias("firsts"), "hours")
    # What a profile owns of a list is short and taken off the list's sums; of the rest, the first one is the most important.
    met = _askers(spark, sf).join(lists, "occupation").withColumns({"met": F.array_intersect("skills", "have"), "skill": F.get(F.array_except("skills", "have"), F.lit(0))}).where(F.col("skill").isNotNull())
    paid = F.aggregate("met", F.lit(0).cast("long"), lambda s, x: s + 8 + 4 * (x % 5))
    p = met.select("profile", F.least(F.lit(3), F.floor(F.col("depth") / 2) + 1).cast("int").alias("stage"), "skill", F.get("firsts", (F.array_position("skills", F.col("skill")) - 1).cast("int")).alias("first"), (F.size("skills") - F.size("met")).cast("long").alias("n"), (F.col("hours") - paid).alias("hours"))
    return p.groupBy("profile", "stage").agg(F.sum("n").alias("skills"), F.sum("hours").alias("hours"), F.ceil(F.sum("hours") / 10.0).cast("long").alias("weeks"), (-F.min("first")).alias("top_priority"), F.min_by("skill", F.struct("first", "skill")).alias("first_skill"))


@query("recommend_details", ctes("requires", "owned", body=_COVERED + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, occupation) AS rank FROM scores) WHERE rank = 1),
tops AS (SELECT occupation, string_agg(CAST(skill AS VARCHAR), ',' ORDER BY r) AS skills FROM (SELECT occupation, skill, row_number() OVER (PARTITION BY occupation ORDER BY w DESC, skill) AS r FROM asked) WHERE r <= 3 GROUP BY occupation),
trend AS (SELECT l_suppkey AS occupation, count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS late, count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01') AS early FROM lineitem GROUP BY 1)
SELECT profile, b.occupation, score, missing AS gaps, skills AS top_skills, CASE WHEN late > early * 1.1::DOUBLE THEN 'up' WHEN late < early * 0.9::DOUBLE THEN 'down' ELSE 'steady' END AS trend FROM best b JOIN tops USING (occupation) JOIN trend USING (occupation)"""))
def recommend_details(spark, sf):
    """M1: the best occupation with its gaps, its three most important skills and the trend of its demand."""
    asked = _weighted(spark, sf)
    tops = asked.withColumn("r", F.row_number().over(Window.partitionBy("occupation").orderBy(F.desc("w"), "skill"))).where("r <= 3").groupBy("occupation")
    tops = tops.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "skill"))), lambda x: x.skill.cast("string")), ",").alias("top_skills"))
    since = F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp")
    demand = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("occupation")).agg(F.count_if(since).alias("late"), F.count_if(~since).alias("early"))
    trend = F.when(F.col("late") > F.col("early") * 1.1, "up").when(F.col("late") < F.col("early") * 0.9, "down").otherwise("steady")
    best = _best(_scores(spark, sf), 1)
    return best.join(tops, "occupation").join(demand, "occupation").select("profile", "occupation", "score", F.col("missing").alias("gaps"), "top_skills", trend.alias("trend"))


@query("match_run", ctes("requires", "owned", body=_COVERED + """,
ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, occupation) AS rank FROM scores) WHERE rank <= 10),
v AS (SELECT o_custkey AS profile, max(o_orderkey) AS version, max(o_orderkey) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS run_version FROM orders GROUP BY 1)
SELECT profile, count(*) AS matches, floor(sum(floor(score * 10000 + 0.5)) / count(*) + 0.5) / 10000 AS confidence, version IS DISTINCT FROM run_version AS stale FROM ten JOIN v USING (profile) GROUP BY profile, version, run_version"""))
def match_run(spark, sf):
    """M3: a run of ten matches at most, its confidence, and whether the profile has changed since."""
    ten = _best(_scores(spark, sf), 10).groupBy("profile").agg(F.count("*").alias("matches"), (F.floor(F.sum(F.floor(F.col("score") * 10000 + 0.5)) / F.count("*") + 0.5) / 10000).alias("confidence"))
    before = F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp")
    versions = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("profile")).agg(F.max("o_orderkey").alias("version"), F.max(F.when(before, F.col("o_orderkey"))).alias("run_version"))
    return ten.join(versions, "profile").select("profile", "matches", "confidence", (~F.col("version").eqNullSafe(F.col("run_version"))).alias("stale"))


_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*'))"
#: What a channel counts for in a memory's score.
CHANNELS = {"trigger": 0.6, "word": 0.3, "persona": 0.1}
#: How a concept may be asked for.
PATTERNS = ("what about {}", "my {}", "{} again")


@query("memory_triggers", f"""
WITH c AS (SELECT DISTINCT conv_id, unnest({_WORDS}) AS concept FROM conversations WHERE role = 'assistant')
SELECT conv_id, concept, replace(pattern, '{{}}', concept) AS trigger FROM c, (SELECT unnest(['what about {{}}', 'my {{}}', '{{}} again']) AS pattern) WHERE length(concept) >= 12""")
def memory_triggers(spark, sf):
    """Each long word of an answer gives a trigger of three patterns."""
    words = F.array_distinct(T.latin_tokens("text"))
    c = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", F.explode(words).alias("concept")).where(F.length("concept") >= 12).distinct()
    patterns = F.explode(F.array(*map(F.lit, PATTERNS))).alias("pattern")
    return c.select("conv_id", "concept", patterns).select("conv_id", "concept", F.replace("pattern", F.lit("{}"), F.col("concept")).alias("trigger"))


@query("memory_context", f"""
WITH asked AS (SELECT DISTINCT conv_id, unnest({_WORDS}) AS term FROM conversations WHERE role = 'user' AND conv_id % 50 = 0),
held AS (SELECT DISTINCT conv_id AS memory, unnest({_WORDS}) AS term FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, count(*) AS n FROM asked WHERE length(term) >= 4 GROUP BY 1),
c AS (SELECT conv_id, memory, count(*) FILTER (length(term) >= 12) AS triggers, count(*) AS words FROM asked JOIN held USING (term) WHERE length(term) >= 4 AND conv_id <> memory GROUP BY ALL),
s AS (SELECT conv_id, memory, floor((0.6::DOUBLE * CASE WHEN triggers > 0 THEN 1 ELSE 0 END + 0.3::DOUBLE * (words / n::DOUBLE) + 0.1::DOUBLE * CASE WHEN conv_id % 7 = memory % 7 THEN 1 ELSE 0 END) * 10000 + 0.5) / 10000 AS score FROM c JOIN n USING (conv_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, memory) AS rank FROM s) WHERE rank <= 5""")
def memory_context(spark, sf):
    """Memories by a trigger met, the share of words met and the same persona, weighted; the conversations divisible by 50 ask all."""
    said = table(spark, sf, "conversations")
    words = F.explode(F.array_distinct(T.latin_tokens("text"))).alias("term")
    asked = said.where("role = 'user' and conv_id % 50 = 0").select("conv_id", words).where(F.length("term") >= 4).distinct()
    held = said.where("role = 'assistant'").select(F.col("conv_id").alias("memory"), words).distinct()
    n = asked.groupBy("conv_id").agg(F.count("*").alias("n"))
    met = asked.join(held, "term").where("conv_id <> memory").groupBy("conv_id", "memory").agg(F.count_if(F.length("term") >= 12).alias("triggers"), F.count("*").alias("words")).join(n, "conv_id")
    trigger, persona = F.when(F.col("triggers") > 0, 1).otherwise(0), F.when(F.col("conv_id") % 7 == F.col("memory") % 7, 1).otherwise(0)
    score = T.half_up(CHANNELS["trigger"] * trigger + CHANNELS["word"] * (F.col("words") / F.col("n")) + CHANNELS["persona"] * persona, 4)
    return met.select("conv_id", "memory", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "memory"))).where("rank <= 5")


@query("history_window", """
WITH b AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, turns FROM b WHERE back <= 6""")
def history_window(spark, sf):
    """The last six turns, numbered in ascending order again, and how many turns there are."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    turns = said.groupBy("conv_id").agg(F.count("*").alias("turns"))
    last = said.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("back <= 6").drop("back")
    return last.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).join(turns, "conv_id")


@query("adjudication", """
WITH decided AS (SELECT d.doc_id, lang, source, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'patch' WHEN d.doc_id % 3 = 0 THEN 'scope' WHEN l.doc_id IS NOT NULL THEN 'annotate' END AS action FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN action = 'patch' THEN 'und' ELSE lang END AS lang, CASE WHEN action = 'scope' THEN source || '/scoped' ELSE source END AS source, CASE WHEN action IN ('annotate', 'patch') THEN action END AS note FROM decided WHERE action IS NULL OR action <> 'reject'""")
def adjudication(spark, sf):
    """Decisions applied: rejected rows go, patches and scopes change a field, annotations add a note."""
    joined = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    action = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "patch").when(F.col("doc_id") % 3 == 0, "scope").when(F.col("quality").isNotNull(), "annotate")
    rows = joined.withColumn("action", F.coalesce(action, F.lit(""))).where("action <> 'reject'")
    return rows.select("doc_id", F.when(F.col("action") == "patch", "und").otherwise(F.col("lang")).alias("lang"), F.when(F.col("action") == "scope", F.concat("source", F.lit("/scoped"))).otherwise(F.col("source")).alias("source"), F.when(F.col("action").isin("annotate", "patch"), F.col("action")).alias("note"))


@query("snapshot_gate", """
WITH s AS (SELECT d.doc_id, sha256(text) AS now, sha256(CASE WHEN d.doc_id % 11 = 0 THEN text || '.' ELSE text END) AS snapshot, quality, toxic, l.doc_id IS NOT NULL AS decided FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN NOT decided THEN 'PENDING' WHEN now <> snapshot THEN 'PENDING: changed' WHEN quality = 1 AND toxic = 0 THEN 'APPROVED' WHEN quality = 1 THEN 'WAIVED' ELSE 'REJECTED' END AS gate FROM s""")
def snapshot_gate(spark, sf):
    """A decision holds only for the text it was taken over."""
    joined = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id", "left")
    snapshot = F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256)
    gate = F.when(F.col("quality").isNull(), "PENDING").when(F.sha2("text", 256) != snapshot, "PENDING: changed").when((F.col("quality") == 1) & (F.col("toxic") == 0), "APPROVED").when(F.col("quality") == 1, "WAIVED").otherwise("REJECTED")
    return joined.select("doc_id", gate.alias("gate"))


@query("refusal_merge", """
WITH old AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM benchmark WHERE item_id % 3 <> 0),
new AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM benchmark),
m AS (SELECT *, 0 AS added FROM old UNION ALL SELECT *, 1 FROM new WHERE id NOT IN (SELECT id FROM old))
SELECT split, count(*) AS rows_, CAST(sum(added) AS BIGINT) AS added FROM m GROUP BY split""")
def refusal_merge(spark, sf):
    """Rows appended where their id is absent, and the counts of each split made anew."""
    new = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test").alias("split"))
    old = new.where("id % 3 <> 0")
    merged = old.withColumn("added", F.lit(0)).union(new.join(old.select("id"), "id", "left_anti").withColumn("added", F.lit(1)))
    return merged.groupBy("split").agg(F.count("*").alias("rows_"), F.sum("added").alias("added"))


@query("cursor_pages", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT user_id, (i - 1) // 50 AS page, count(*) AS rows_, any_value(total) AS total, CASE WHEN max(i) < any_value(total) THEN max(i) END AS next_cursor, arg_max(event_id, i) AS last FROM r GROUP BY user_id, (i - 1) // 50""")
def cursor_pages(spark, sf):
    """K5: every page of every user's events with the total and the next page's cursor, null at the end."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    events = table(spark, sf, "events")
    total = events.groupBy("user_id").agg(F.count("*").alias("total"))
    rows = events.select("user_id", "event_id", F.row_number().over(w).alias("i")).withColumn("page", F.floor((F.col("i") - 1) / 50))
    pages = rows.groupBy("user_id", "page").agg(F.count("*").alias("rows_"), F.max("i").alias("last_i"), F.max_by("event_id", "i").alias("last")).join(total, "user_id")
    return pages.select("user_id", "page", "rows_", "total", F.when(F.col("last_i") < F.col("total"), F.col("last_i").cast("long")).alias("next_cursor"), "last")


@query("merged_cells", """
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS row_, CAST(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS INTEGER) AS head, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS cell FROM orders),
g AS (SELECT *, sum(head) OVER (PARTITION BY doc ORDER BY row_) AS level FROM o)
SELECT row_ AS id, CAST(level AS INTEGER) AS level, last_value(cell IGNORE NULLS) OVER (PARTITION BY doc, level ORDER BY row_ ROWS UNBOUNDED PRECEDING) AS filled FROM g""")
def merged_cells(spark, sf):
    """Merged cells filled from above, anew under each heading."""
    head = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), head.alias("head"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("cell"))
    rows = rows.withColumn("level", F.sum("head").over(Window.partitionBy("doc").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("doc", "level").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("id", F.col("level").cast("int").alias("level"), F.last("cell", ignorenulls=True).over(w).alias("filled"))


_NEAR = """
, near AS (SELECT src, dst FROM transitions UNION SELECT dst, src FROM transitions),
hop1 AS (SELECT DISTINCT dst AS node FROM near WHERE src = 5 AND dst <> 5),
hop2 AS (SELECT DISTINCT n.dst AS node FROM near n JOIN hop1 ON n.src = hop1.node WHERE n.dst <> 5 AND n.dst NOT IN (SELECT node FROM hop1)),
v AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey = 5 THEN 'focal' WHEN s_suppkey IN (SELECT node FROM hop1) THEN 'hop1' WHEN s_suppkey IN (SELECT node FROM hop2) THEN 'hop2' WHEN s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 5) THEN 'context' ELSE 'dimmed' END AS state FROM supplier)"""


def _view(spark, sf):
    """node and state of all occupations, seen from number 5."""
    edges = domain.transitions(spark, sf)
    hops = graph.hops(edges, spark.createDataFrame([(5,)], "seed long"), 2).select("node", "hop")
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey")
    own = nodes.where("node = 5").select(F.col("s_nationkey").alias("own"))
    rows = nodes.join(hops, "node", "left").join(own, F.col("s_nationkey") == F.col("own"), "left")
    state = F.when(F.col("hop") == 0, "focal").when(F.col("hop") == 1, "hop1").when(F.col("hop") == 2, "hop2").when(F.col("own").isNotNull(), "context").otherwise("dimmed")
    return edges, rows.select("node", state.alias("state"))


@query("graph_view_nodes", ctes("transitions", body=_NEAR + " SELECT node, state FROM v"))
def graph_view_nodes(spark, sf):
    """Nodes as focal, one or two steps away, of the same context or dimmed."""
    return _view(spark, sf)[1]


@query("graph_view_edges", ctes("transitions", body=_NEAR + """
SELECT src, dst, CASE WHEN a.state = 'focal' THEN 'outgoing' WHEN b.state = 'focal' THEN 'incoming' WHEN a.state IN ('hop1', 'hop2') AND b.state IN ('hop1', 'hop2') THEN 'between' WHEN a.state = 'dimmed' OR b.state = 'dimmed' THEN 'dimmed' ELSE 'context' END AS state
FROM transitions JOIN v a ON a.node = src JOIN v b ON b.node = dst"""))
def graph_view_edges(spark, sf):
    """Edges by the states of their ends."""
    edges, nodes = _view(spark, sf)
    rows = edges.join(nodes.toDF("src", "a"), "src").join(nodes.toDF("dst", "b"), "dst")
    near = ["hop1", "hop2"]
    state = F.when(F.col("a") == "focal", "outgoing").when(F.col("b") == "focal", "incoming").when(F.col("a").isin(near) & F.col("b").isin(near), "between").when((F.col("a") == "dimmed") | (F.col("b") == "dimmed"), "dimmed").otherwise("context")
    return rows.select("src", "dst", state.alias("state"))


@query("library_union", """
WITH a AS (SELECT 'node:' || s_suppkey AS id, 'occupations' AS library FROM supplier), b AS (SELECT 'node:' || (c_custkey + 50) AS id, 'profiles' AS library FROM customer), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
n AS (SELECT id, count(*) AS n FROM u GROUP BY id)
SELECT library, count(*) AS nodes, count(*) FILTER (n > 1) AS collisions FROM u JOIN n USING (id) GROUP BY library""")
def library_union(spark, sf):
    """Libraries united, with the ids that more than one of them has."""
    a = table(spark, sf, "supplier").select(F.concat(F.lit("node:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("occupations").alias("library"))
    b = table(spark, sf, "customer").select(F.concat(F.lit("node:"), (F.col("c_custkey") + 50).cast("string")).alias("id"), F.lit("profiles").alias("library"))
    both = a.unionByName(b)
    n = both.groupBy("id").agg(F.count("*").alias("n"))
    return both.join(n, "id").groupBy("library").agg(F.count("*").alias("nodes"), F.count_if(F.col("n") > 1).alias("collisions"))


@query("page_hints", r"""
SELECT page_id, lower(regexp_extract(html, '(?i)<meta[^>]+charset\s*=\s*["'']?([A-Za-z0-9_-]+)', 1)) AS charset, regexp_extract(html, '(?i)<meta[^>]+http-equiv\s*=\s*["'']?refresh["'']?[^>]*url\s*=\s*([^"''>\s]+)', 1) AS refresh FROM pages""")
def page_hints(spark, sf):
    """The charset that a page states and the address that it refreshes to."""
    return table(spark, sf, "pages").select("page_id", T.stated_charset("html").alias("charset"), T.refresh_target("html").alias("refresh"))


#: Checks that wait for a stage that has not run yet.
PENDING = ("C14",)


@query("contract_checks", ctes("requires", "prerequisites", body="""
, front AS (SELECT page_id FROM pages WHERE NOT regexp_matches(html, '(?i)<html[^>]*lang="(en|fr)"') OR NOT regexp_matches(html, '(?i)<title') OR url = ''),
v AS (SELECT 'C2' AS check_id, 'hard' AS level, CAST(doc_id AS VARCHAR) AS sample FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)
  UNION ALL SELECT 'C6', 'hard', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey NOT IN (SELECT skill FROM requires WHERE target_level >= 2)
  UNION ALL SELECT 'C9', 'hard', CAST(page_id AS VARCHAR) FROM front
  UNION ALL SELECT 'C10', 'warn', min(p_partkey) || '' FROM part GROUP BY p_size, floor(p_retailprice / 10) HAVING count(*) > 1
  UNION ALL SELECT 'C14', 'warn', CAST(p_partkey AS VARCHAR) FROM part JOIN documents ON doc_id = p_partkey WHERE NOT contains(lower(text), string_split(lower(p_name), ' ')[-1])),
ids AS (SELECT unnest(['C2', 'C6', 'C9', 'C10', 'C14']) AS check_id, unnest(['hard', 'hard', 'hard', 'warn', 'warn']) AS level),
n AS (SELECT check_id, count(*) AS violations, array_to_string(list_sort(list(sample))[1:10], ',') AS samples FROM v GROUP BY check_id)
SELECT check_id, level, coalesce(violations, 0) AS violations, CASE WHEN check_id = 'C14' THEN 'pending' WHEN violations IS NULL THEN 'pass' WHEN level = 'hard' THEN 'fail' ELSE 'warn' END AS status, coalesce(samples, '') AS samples FROM ids LEFT JOIN n USING (check_id)"""))
def contract_checks(spark, sf):
    """References, evidence, front matter, coordinates and names, with ten samples at most and a pending state."""
    labels, part, pages = table(spark, sf, "labels"), table(spark, sf, "part"), table(spark, sf, "pages")
    kept = table(spark, sf, "documents").where("doc_id % 5 <> 0").select("doc_id")
    proven = domain.requires(spark, sf).where("target_level >= 2").select(F.col("skill").alias("p_partkey"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("p_partkey"), "text")
    violations = {
        ("C2", "hard"): labels.join(kept, "doc_id", "left_anti").select(F.col("doc_id").alias("id")),
        ("C6", "hard"): part.join(proven, "p_partkey", "left_anti").select(F.col("p_partkey").alias("id")),
        ("C9", "hard"): pages.where(~F.col("html").rlike('(?i)<html[^>]*lang="(en|fr)"') | ~F.col("html").rlike("(?i)<title") | (F.col("url") == "")).select(F.col("page_id").alias("id")),
        ("C10", "warn"): part.groupBy("p_size", F.floor(F.col("p_retailprice") / 10)).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n")).where("n > 1").select("id"),
        ("C14", "warn"): part.join(texts, "p_partkey").where(~F.contains(F.lower("text"), F.element_at(F.split(F.lower("p_name"), " "), -1))).select(F.col("p_partkey").alias("id")),
    }
    rows = []
    for (name, level), found in violations.items():
        ids = found.select(F.col("id").cast("string").alias("id"))
        samples = ids.orderBy("id").limit(10).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("samples"))
        row = check(ids, name, level).join(samples)
        rows.append(row.withColumn("status", F.lit("pending")) if name in PENDING else row)
    return reduce(lambda a, b: a.unionByName(b), rows)
