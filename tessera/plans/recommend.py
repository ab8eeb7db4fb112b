"""Queries of recommendation, matching and learning paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import half_up
from tessera.operators import graph
from tessera.plans.graph import _CLOSURE, _recursive
from tessera.plans.registry import query
from tessera.sources import domain
from tessera.sources.domain import ctes, table

_COVERED = """,
asked AS (SELECT occupation, skill, importance, target_level, floor(importance * 1000 + 0.5) AS w FROM requires),
totals AS (SELECT occupation, sum(w) AS total, count(*) AS skills FROM asked GROUP BY occupation),
covered AS (SELECT profile, occupation, sum(w) AS have, count(*) AS owned FROM owned JOIN asked USING (skill) GROUP BY ALL),
scores AS (SELECT profile, occupation, floor(have / total * 10000 + 0.5) / 10000 AS score, owned, skills - owned AS missing FROM covered JOIN totals USING (occupation))"""


def _weighted(spark, sf):
    return domain.requires(spark, sf).withColumn("w", F.floor(F.col("importance") * 1000 + 0.5))


#: Order lines whose profiles one task matches with occupations.
LINES_IN_TASK = 100_000
#: Low bits of a number in a list, as many as a smallint has.
LOW_BITS, LOW = 15, (1 << 15) - 1


def _scores(spark, sf, facts=None):
    """profile, occupation, score (weighted coverage), owned and missing, with the columns of ``facts`` (one row of an occupation).

    A profile meets some thirty times as many occupations as it has skills. So what moves to it is each of its skills
    once, with the list of who asks for it; pairs are first made in the task that adds them up. The one row of each
    occupation is sent to every task.
    """
    asked = _weighted(spark, sf)
    totals = asked.groupBy("occupation").agg(F.sum("w").alias("total"), F.count("*").alias("skills"))
    if facts is not None:
        totals = totals.join(facts, "occupation")
    askers = asked.where("occupation IS NOT NULL").groupBy("skill").agg(F.array_sort(F.collect_list(F.struct("occupation", "w"))).alias("askers"))
    # Low and high bits lie in lists of their own: high ones hardly differ within a list, so they take no room when shuffled.
    low, high = lambda x: F.transform(x, lambda v: v.bitwiseAND(LOW).cast("smallint")), lambda x: F.transform(x, lambda v: F.shiftright(v, LOW_BITS))
    askers = askers.select("skill", *(f(F.col(f"askers.{c}")).alias(f"{c}_{n}") for c in ("occupation", "w") for n, f in (("low", low), ("high", high))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf, "lineitem").count() // LINES_IN_TASK))
    met = domain.owned(spark, sf).join(askers, "skill").drop("skill").repartition(tasks, "profile")
    whole = [(F.shiftleft(F.col(f"{c}_high"), LOW_BITS) + F.col(f"{c}_low")).alias(c) for c in ("occupation", "w")]
    pairs = met.select("profile", F.inline(F.arrays_zip(*(c for c in met.columns if c != "profile")))).select("profile", *whole)
    have = pairs.groupBy("profile", "occupation").agg(F.sum("w").alias("have"), F.count("*").alias("owned"))
    extra = [] if facts is None else [c for c in facts.columns if c != "occupation"]
    return have.join(F.broadcast(totals), "occupation").select("profile", "occupation", half_up(F.col("have") / F.col("total"), 4).alias("score"), "owned", (F.col("skills") - F.col("owned")).alias("missing"), *extra)


def _best(df, k, by="profile", item="occupation"):
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))).where(F.col("rank") <= k)


@query("recommend_coverage", ctes("requires", "owned", body=_COVERED + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, occupation) AS rank FROM scores) WHERE rank <= 3"""))
def recommend_coverage(spark, sf):
    """Occupations by importance-weighted coverage."""
    return _best(_scores(spark, sf), 3)


@query("career_match", ctes("requires", "owned", body=_COVERED + """,
facts AS (SELECT s.*, CAST(c_nationkey = s_nationkey AS INTEGER) AS near, least(1.0::DOUBLE, owned / 20.0::DOUBLE) AS experience, CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS feasible
  FROM scores s JOIN customer ON c_custkey = profile JOIN supplier ON s_suppkey = occupation),
m AS (SELECT profile, occupation, round_even(CAST(100 * (0.5::DOUBLE * score + 0.25::DOUBLE * near + 0.15::DOUBLE * experience + 0.1::DOUBLE * feasible) AS DOUBLE), 0) AS score FROM facts),
r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, occupation) AS rank FROM m)
SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'middle' ELSE 'low' END AS level FROM r WHERE rank <= 10"""))
def career_match(spark, sf):
    """M2, M3: four weighted dimensions, bankers' rounding, ten best, a level."""
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile"), "c_nationkey")
    what = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("occupation"), "s_nationkey", "s_acctbal")
    facts = _scores(spark, sf, what).join(who, "profile")
    near, feasible = (F.col("c_nationkey") == F.col("s_nationkey")).cast("int"), F.when(F.col("s_acctbal") > 0, 1).otherwise(0)
    total = 0.5 * F.col("score") + 0.25 * near + 0.15 * F.least(F.lit(1.0), F.col("owned") / 20.0) + 0.1 * feasible
    found = _best(facts.select("profile", "occupation", F.bround(100 * total).alias("score")), 10)
    return found.withColumn("level", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "middle").otherwise("low"))


_GAP = ctes("requires", "owned", "prerequisites", "targets", body=_CLOSURE + """,
direct AS (SELECT profile, skill FROM target JOIN requires USING (occupation)),
needed AS (SELECT profile, skill FROM direct UNION SELECT profile, src FROM direct JOIN closure ON dst = skill),
gap AS (SELECT n.profile, n.skill FROM needed n WHERE NOT EXISTS (FROM owned o WHERE o.profile = n.profile AND o.skill = n.skill)),
d AS (SELECT p_partkey AS skill, coalesce(max(depth), 0) AS depth FROM part LEFT JOIN closure ON dst = p_partkey GROUP BY 1)""").replace("WITH ", "WITH RECURSIVE ", 1)


_targets = domain.targets


def _needs(spark, sf, *columns):
    """occupation, skill, depth and priority of what an occupation needs: directly, with its weight, or before that, with none; with columns of the skills.

    What an occupation needs is found once, however many profiles ask for it; all rows of one lie in one task.
    """
    edges = domain.prerequisites(spark, sf)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("skill"), *columns)
    depth = graph.depths(part.select(F.col("skill").alias("node")), edges).toDF("skill", "depth")
    depth = depth.join(part, "skill") if columns else depth
    before = graph.closure(edges).select(F.col("dst").alias("asked"), F.col("src").alias("skill")).join(depth, "skill")
    reached = before.unionByName(depth.withColumn("asked", F.col("skill")))
    direct = _weighted(spark, sf).select("occupation", F.col("skill").alias("asked"), "w")
    every = direct.join(reached, "asked").select("occupation", "skill", "depth", *columns, F.when(F.col("asked") == F.col("skill"), F.col("w")).alias("priority"))
    return every.repartition("occupation").groupBy("occupation", "skill", "depth", *columns).agg(F.max("priority").alias("priority"))


def _askers(spark, sf):
    """profile, occupation (its target) and have: all skills that it owns, as one list."""
    owned = domain.owned(spark, sf).groupBy("profile").agg(F.collect_list("skill").alias("have"))
    return _targets(spark, sf).join(owned, "profile", "left").withColumn("have", F.coalesce("have", F.array().cast("array<bigint>")))


def _missing(spark, sf):
    """profile, depth and missing: the skills of that depth that the profile's target needs and the profile lacks, as one list.

    Lists meet where the occupation lies, so that what profiles lack, thousands of rows of each, need not be moved.
    """
    lists = _needs(spark, sf).groupBy("occupation", "depth").agg(F.collect_list("skill").alias("skills"))
    return _askers(spark, sf).join(lists, "occupation").select("profile", "depth", F.array_except("skills", "have").alias("missing"))


def _gap(spark, sf):
    """profile, skill and depth of what a target occupation needs, directly or before it, and the profile lacks."""
    return _missing(spark, sf).select("profile", F.explode("missing").alias("skill"), "depth")


@query("skill_gap", _GAP + " SELECT profile, skill, depth FROM gap JOIN d USING (skill)")
def skill_gap(spark, sf):
    """Missing skills with their prerequisites."""
    return _gap(spark, sf)


@query("learning_path_gap", _GAP + """
SELECT profile, depth, count(*) AS skills, CAST(sum(8 + 4 * (skill % 5)) AS BIGINT) AS hours, CAST(ceil(sum(8 + 4 * (skill % 5)) / 10.0) AS BIGINT) AS weeks, row_number() OVER (PARTITION BY profile ORDER BY depth) AS step
FROM gap JOIN d USING (skill) GROUP BY profile, depth""")
def learning_path_gap(spark, sf):
    """M4: hours and weeks of each depth of a learning path."""
    hours = F.sum(8 + 4 * (F.col("skill") % 5))
    steps = _gap(spark, sf).groupBy("profile", "depth").agg(F.count("*").alias("skills"), hours.cast("long").alias("hours"), F.ceil(hours / 10.0).cast("long").alias("weeks"))
    return steps.withColumn("step", F.row_number().over(Window.partitionBy("profile").orderBy("depth")))


@query("gap_summary", _GAP + """
SELECT t.profile, count(*) AS required, count(g.skill) AS missing FROM (SELECT profile, skill FROM direct) t LEFT JOIN gap g ON g.profile = t.profile AND g.skill = t.skill GROUP BY t.profile""")
def gap_summary(spark, sf):
    """How many direct requirements are met."""
    direct = _targets(spark, sf).join(domain.requires(spark, sf), "occupation").select("profile", "skill")
    have = domain.owned(spark, sf).withColumn("have", F.lit(1))
    return direct.join(have, ["profile", "skill"], "left").groupBy("profile").agg(F.count("*").alias("required"), F.count_if(F.col("have").isNull()).alias("missing"))


@query("catalog_summary", ctes("requires", body="""
SELECT occupation, count(*) AS skills, floor(avg(importance) * 10000 + 0.5) / 10000 AS mean, max(target_level) AS level, count(DISTINCT p_brand) AS domains, (SELECT count(*) FROM requires r2 WHERE r2.occupation = r.occupation AND importance >= 0.5) AS core
FROM requires r JOIN part ON skill = p_partkey GROUP BY occupation"""))
def catalog_summary(spark, sf):
    """M6: one row per occupation."""
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("skill"), "p_brand")
    return domain.requires(spark, sf).join(brands, "skill").groupBy("occupation").agg(F.count("*").alias("skills"), half_up(F.avg("importance"), 4).alias("mean"), F.max("target_level").alias("level"), F.countDistinct("p_brand").alias("domains"), F.count_if(F.col("importance") >= 0.5).alias("core"))


@query("catalog_skills", ctes("requires", body="""
SELECT occupation, string_agg(skill, ',' ORDER BY importance DESC, target_level DESC, skill) AS skills FROM (
  SELECT *, row_number() OVER (PARTITION BY occupation ORDER BY importance DESC, target_level DESC, skill) AS rn FROM requires) WHERE rn <= 5 GROUP BY occupation"""))
def catalog_skills(spark, sf):
    """M6, K3, K6: each occupation's five foremost skills, in order."""
    order = Window.partitionBy("occupation").orderBy(F.desc("importance"), F.desc("target_level"), "skill")
    few = domain.requires(spark, sf).withColumn("rn", F.row_number().over(order)).where("rn <= 5")
    return few.groupBy("occupation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "skill"))), lambda x: x.skill.cast("string")), ",").alias("skills"))


@query("candidate_occupations", """
SELECT n_nationkey AS nation, s_suppkey AS occupation FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE contains(lower(n_name), '1') OR contains('nation_3 or nation 4', lower(n_name))""")
def candidate_occupations(spark, sf):
    """Names that contain the words or are contained in them."""
    name = F.lower("n_name")
    found = table(spark, sf, "nation").where(name.contains("1") | F.lit("nation_3 or nation 4").contains(name)).select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf, "supplier").join(found, "s_nationkey").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("occupation"))


@query("task_status", """
WITH s AS (SELECT o_custkey AS profile, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS stage, o_orderstatus = 'F' AS done FROM orders),
per AS (SELECT profile, stage, count(*) AS tasks, count(*) FILTER (done) AS finished FROM s GROUP BY ALL),
open_ AS (SELECT profile, min(stage) AS current FROM per WHERE finished < tasks GROUP BY profile)
SELECT profile, stage, tasks, finished, CASE WHEN finished = tasks THEN 'done' WHEN stage = current THEN 'available' ELSE 'locked' END AS status FROM per LEFT JOIN open_ USING (profile)""")
def task_status(spark, sf):
    """The first stage that is not finished is available, later ones are locked."""
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("profile"), stage.alias("stage")).agg(F.count("*").alias("tasks"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    current = F.min(F.when(F.col("finished") < F.col("tasks"), F.col("stage"))).over(Window.partitionBy("profile"))
    return per.withColumn("current", current).select("profile", "stage", "tasks", "finished", F.when(F.col("finished") == F.col("tasks"), "done").when(F.col("stage") == F.col("current"), "available").otherwise("locked").alias("status"))


@query("profile_augmentation", """
WITH base AS (SELECT c_custkey AS profile, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS direction FROM customer),
extra AS (SELECT o_custkey AS profile, max(o_orderpriority) AS direction FROM orders GROUP BY 1)
SELECT profile, coalesce(b.direction, e.direction) AS direction, CASE WHEN b.direction IS NOT NULL THEN 'profile' WHEN e.direction IS NOT NULL THEN 'memory' ELSE 'none' END AS origin FROM base b LEFT JOIN extra e USING (profile)""")
def profile_augmentation(spark, sf):
    """Memory fills gaps of the profile, with its origin."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("profile"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("own"))
    extra = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("profile")).agg(F.max("o_orderpriority").alias("memory"))
    origin = F.when(F.col("own").isNotNull(), "profile").when(F.col("memory").isNotNull(), "memory").otherwise("none")
    return base.join(extra, "profile", "left").select("profile", F.coalesce("own", "memory").alias("direction"), origin.alias("origin"))


@query("dimension_report", """
WITH d AS (SELECT l_suppkey AS occupation, p_type AS dimension, avg(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE WHEN l_returnflag = 'A' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END) AS score, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT occupation, floor(sum(score * n) / sum(n) * 10000 + 0.5) / 10000 AS overall, arg_max(dimension, (floor(score * 1000000), dimension)) AS best, arg_min(dimension, (floor(score * 1000000), dimension)) AS worst FROM d GROUP BY occupation""")
def dimension_report(spark, sf):
    """Dimension scores with partial credit, the best and the worst."""
    # Hundredths are whole numbers, so sums do not hang on the order of the rows.
    credit = F.when(F.col("l_returnflag") == "N", 100).when(F.col("l_returnflag") == "A", 35).otherwise(0)
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("dimension"))
    d = table(spark, sf, "lineitem").join(kinds, "l_partkey").groupBy(F.col("l_suppkey").alias("occupation"), "dimension").agg(F.sum(credit).alias("points"), F.count("*").alias("n"))
    key = F.struct(F.expr("points * 10000L div n").alias("score"), "dimension")
    overall = F.expr("(sum(points) * 20000L + 100L * sum(n)) div (200L * sum(n))") / 10000
    return d.groupBy("occupation").agg(overall.alias("overall"), F.max_by("dimension", key).alias("best"), F.min_by("dimension", key).alias("worst"))
