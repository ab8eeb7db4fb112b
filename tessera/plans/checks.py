"""Integrity checks: one row per check with its level, status and number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.registry import query
from tessera.sources import domain
from tessera.sources.domain import ctes, table


def check(violations, name: str, level: str = "hard"):
    """check_id, level, violations and status of a DataFrame of violations."""
    n = violations.agg(F.count("*").alias("violations"))
    status = F.when(F.col("violations") == 0, "pass").when(F.lit(level) == "hard", "fail").otherwise("warn")
    return n.select(F.lit(name).alias("check_id"), F.lit(level).alias("level"), "violations", status.alias("status"))


@query("integrity_report", ctes("requires", "prerequisites", body="""
, walk AS (SELECT src, dst FROM prerequisites UNION SELECT w.src, p.dst FROM walk w JOIN prerequisites p ON w.dst = p.src),
v AS (
  SELECT 'C1' AS check_id, 'hard' AS level, (SELECT count(*) FROM prerequisites WHERE src NOT IN (SELECT p_partkey FROM part) OR dst NOT IN (SELECT p_partkey FROM part)) AS violations
  UNION ALL SELECT 'C3', 'hard', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O', 'P'))
  UNION ALL SELECT 'C4', 'hard', (SELECT count(DISTINCT src) FROM walk WHERE src = dst)
  UNION ALL SELECT 'C5', 'hard', (SELECT count(*) FROM requires WHERE occupation NOT IN (SELECT s_suppkey FROM supplier) OR skill NOT IN (SELECT p_partkey FROM part))
  UNION ALL SELECT 'C6', 'warn', (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT skill FROM requires))
  UNION ALL SELECT 'C7', 'hard', (SELECT count(*) FROM (SELECT src, dst FROM prerequisites GROUP BY ALL HAVING count(*) > 1))
  UNION ALL SELECT 'C10', 'hard', (SELECT count(*) FROM part WHERE p_size IS NULL OR p_retailprice IS NULL)
  UNION ALL SELECT 'C11', 'hard', (SELECT count(*) FROM requires WHERE importance <= 0 OR importance > 1)
  UNION ALL SELECT 'C12', 'warn', (SELECT count(*) FROM (SELECT lower(p_name) FROM part GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'C13', 'warn', (SELECT CASE WHEN count(*) BETWEEN 40 AND 100 THEN 0 ELSE 1 END FROM supplier)
  UNION ALL SELECT 'C14', 'warn', (SELECT count(*) FROM pages WHERE NOT contains(lower(html), '<h1')))
SELECT check_id, level, violations, CASE WHEN violations = 0 THEN 'pass' WHEN level = 'hard' THEN 'fail' ELSE 'warn' END AS status FROM v""").replace("WITH ", "WITH RECURSIVE ", 1))
def integrity_report(spark, sf):
    """Every check, hard ones fail, others warn."""
    part, requires, before = table(spark, sf, "part"), domain.requires(spark, sf), domain.prerequisites(spark, sf)
    skills = part.select(F.col("p_partkey").alias("node"))
    occupations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    wrong = requires.join(occupations, F.col("occupation") == F.col("node"), "left_anti").union(requires.join(skills, F.col("skill") == F.col("node"), "left_anti"))
    scale = table(spark, sf, "supplier").agg(F.count("*").alias("n")).where(~F.col("n").between(40, 100))
    rows = [
        check(graph.dangling(before, skills).select("src", "dst").distinct(), "C1"),
        check(table(spark, sf, "orders").where(~F.col("o_orderstatus").isin("F", "O", "P")), "C3"),
        check(graph.cyclic(before), "C4"),
        check(wrong.distinct(), "C5"),
        check(skills.join(requires, F.col("node") == F.col("skill"), "left_anti"), "C6", "warn"),
        check(before.groupBy("src", "dst").count().where("count > 1"), "C7"),
        check(part.where("p_size is null or p_retailprice is null"), "C10"),
        check(requires.where("importance <= 0 or importance > 1"), "C11"),
        check(part.groupBy(F.lower("p_name")).count().where("count > 1"), "C12", "warn"),
        check(scale, "C13", "warn"),
        check(table(spark, sf, "pages").where(~F.lower("html").contains("<h1")), "C14", "warn"),
    ]
    return reduce(lambda a, b: a.union(b), rows)


@query("weight_rule", ctes("requires", body=" SELECT occupation, skill FROM (SELECT occupation, skill, importance * CASE WHEN skill % 37 = 0 THEN 3 ELSE 1 END AS importance, CASE WHEN skill % 41 = 0 THEN 9 ELSE target_level END AS target_level FROM requires) WHERE floor(importance * 1000 + 0.5) / 1000 > 1 OR target_level NOT BETWEEN 1 AND 5"))
def weight_rule(spark, sf):
    """Weights and levels outside their range, after some have been spoilt."""
    spoilt = domain.requires(spark, sf).withColumns({"importance": F.col("importance") * F.when(F.col("skill") % 37 == 0, 3).otherwise(1), "target_level": F.when(F.col("skill") % 41 == 0, 9).otherwise(F.col("target_level"))})
    return spoilt.where("floor(importance * 1000 + 0.5) / 1000 > 1 or target_level not between 1 and 5").select("occupation", "skill")


@query("question_rules", ctes("gold", body="""
SELECT b.item_id AS qid, concat_ws(',', CASE WHEN length(b.text) < 60 THEN 'short' END, CASE WHEN n IS NULL THEN 'no reference' END, CASE WHEN n > 3 THEN 'many references' END) AS broken
FROM benchmark b LEFT JOIN (SELECT qid, count(*) AS n FROM gold GROUP BY qid) g ON g.qid = b.item_id WHERE length(b.text) < 60 OR n IS NULL OR n > 3"""))
def question_rules(spark, sf):
    """Rules that a question set must keep."""
    refs = domain.gold(spark, sf).groupBy("qid").agg(F.count("*").alias("n"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text").join(refs, "qid", "left")
    broken = F.concat_ws(",", F.when(F.length("text") < 60, "short"), F.when(F.col("n").isNull(), "no reference"), F.when(F.col("n") > 3, "many references"))
    return items.select("qid", broken.alias("broken")).where("broken <> ''")


@query("availability_flags", ctes("gold", body=" SELECT doc_id, EXISTS (FROM labels l WHERE l.doc_id = d.doc_id) AS cited, EXISTS (FROM gold g WHERE g.doc_id = d.doc_id) AS used FROM documents d"))
def availability_flags(spark, sf):
    """Which documents are cited or used."""
    cited = table(spark, sf, "labels").select("doc_id").distinct().withColumn("cited", F.lit(True))
    used = domain.gold(spark, sf).select("doc_id").distinct().withColumn("used", F.lit(True))
    return table(spark, sf, "documents").select("doc_id").join(cited, "doc_id", "left").join(used, "doc_id", "left").na.fill(False, ["cited", "used"])


@query("pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, floor(sum(l_extendedprice) * 100 + 0.5) / 100 AS sum_price, floor(avg(l_discount) * 10000 + 0.5) / 10000 AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    """A plain grouped aggregation with a filter that reaches the scan."""
    items = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), (F.floor(F.sum("l_extendedprice") * 100 + 0.5) / 100).alias("sum_price"), (F.floor(F.avg("l_discount") * 10000 + 0.5) / 10000).alias("avg_disc"), F.count("*").alias("n"))
