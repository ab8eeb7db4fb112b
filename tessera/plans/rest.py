"""Queries of projections, soft deletes, first positions and compositions over the graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import html, retrieval
from tessera.plans.registry import query
from tessera.plans.retrieval import _BOTH, _CHANNELS, _SCALED, _bm25, _dense, _fused
from tessera.sources import domain
from tessera.sources.domain import ctes, table


@query("stated_dates", "SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN '20' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || '-05-06' END AS published, CAST(NULL AS VARCHAR) AS modified, CAST(doc_id % 3 = 0 AS INTEGER) AS nodes FROM documents UNION ALL SELECT -1 - page_id, NULL, NULL, 0 FROM pages")
def stated_dates(spark, sf):
    """Dates that pages state in JSON-LD: the driver's pages, which state none, and documents as pages that do."""
    year = F.lpad((F.col("doc_id") % 24).cast("string"), 2, "0")
    data = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"@graph": [{"@type": ["Report", "Thing"], "datePublished": "20'), year, F.lit('-05-06T01:02"}]}')))
    data = data.when(F.col("doc_id") % 3 == 1, '{"@type": "Person", "datePublished": "2020-01-01"}').otherwise("{")
    made = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit('<html><script type="application/ld+json">'), data, F.lit("</script>"), "text").alias("html"))
    pages = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("page_id"), "html")
    return html.stated_dates(pages.union(made))


@query("live_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_acctbal >= 0")
def live_join(spark, sf):
    """An inner join without what is marked as deleted; both filters reach the scans."""
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("node_contract", ctes("nodes", body=" SELECT id, kind, label, CASE WHEN kind = 'skill' THEN length(label) END AS label_chars FROM nodes WHERE kind IN ('skill', 'domain')"))
def node_contract(spark, sf):
    """Stated fields only, one of them for one kind only, of the listed kinds (no list: all)."""
    kinds = ["skill", "domain"]
    rows = domain.nodes(spark, sf)
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    return rows.select("id", "kind", "label", F.when(F.col("kind") == "skill", F.length("label")).alias("label_chars"))


@query("edges_of_node", ctes("transitions", body=" SELECT 'out' AS side, src, dst FROM transitions WHERE src = 5 UNION ALL SELECT 'in', src, dst FROM transitions WHERE dst = 5"))
def edges_of_node(spark, sf):
    """Outgoing and incoming edges of one node."""
    edges = domain.transitions(spark, sf)
    return edges.where("src = 5").select(F.lit("out").alias("side"), "src", "dst").union(edges.where("dst = 5").select(F.lit("in"), "src", "dst"))


@query("adapter_rejects", "SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'STANDARD') THEN lower(p_type) ELSE 'dropped' END AS label, count(*) AS rows_ FROM part GROUP BY 1")
def adapter_rejects(spark, sf):
    """Types that a map knows, and how many rows it drops."""
    known = F.create_map(*[F.lit(x) for t in ("ECONOMY", "SMALL", "STANDARD") for x in (t, t.lower())])
    return table(spark, sf, "part").groupBy(F.coalesce(F.element_at(known, F.col("p_type")), F.lit("dropped")).alias("label")).agg(F.count("*").alias("rows_"))


@query("anchor_ranks", ctes(*_CHANNELS, "gold", body=" SELECT g.qid, count(*) AS anchors, count(b.rank) AS found, CASE WHEN count(b.rank) = count(*) THEN max(b.rank) END AS all_by FROM gold g LEFT JOIN bm25 b USING (qid, doc_id) GROUP BY g.qid"))
def anchor_ranks(spark, sf):
    """The rank by which every anchor of a question has been met; null where one is missing."""
    marked = domain.gold(spark, sf).join(_bm25(spark, sf).select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    return marked.groupBy("qid").agg(F.count("*").alias("anchors"), F.count("rank").alias("found"), F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("all_by"))


@query("stable_positions", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(CASE WHEN l_returnflag = 'N' THEN l_linenumber END, 1000000), l_linenumber) AS place FROM lineitem""")
def stable_positions(spark, sf):
    """K4: rows without a position come last, in their own order."""
    position = F.coalesce(F.when(F.col("l_returnflag") == "N", F.col("l_linenumber")), F.lit(1_000_000))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(position, "l_linenumber")).alias("place"))


@query("node_references", "SELECT p_partkey AS node, l_orderkey AS ref FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 1 UNION SELECT l_partkey, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def node_references(spark, sf):
    """References of nodes and of their edges, distinct."""
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("ref"))
    small = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    open_orders = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("ref"))
    return items.join(small, "node", "left_semi").union(items.join(open_orders, "ref", "left_semi").select("node", "ref")).distinct()


@query("graph_search", ctes("requires", "transitions", body="""
, hits AS (SELECT s_suppkey AS node, CASE WHEN s_name = 'Supplier#000000007' THEN 3 ELSE 1 END AS score FROM supplier WHERE contains(s_name, '7')),
near AS (SELECT src AS node, dst AS other FROM transitions UNION SELECT dst, src FROM transitions),
n AS (SELECT node, 0 AS hop, score FROM hits UNION ALL SELECT other, 1, score FROM hits JOIN near USING (node)),
best AS (SELECT node, min(hop) AS hop, max(score) AS score FROM n GROUP BY node)
SELECT node, hop, score, count(skill) AS skills FROM best LEFT JOIN requires ON occupation = node GROUP BY ALL"""))
def graph_search(spark, sf):
    """Matching nodes, their neighbours, and what stands behind them."""
    name = F.col("s_name")
    hits = table(spark, sf, "supplier").where(name.contains("7")).select(F.col("s_suppkey").alias("node"), F.when(name == "Supplier#000000007", 3).otherwise(1).alias("score"))
    edges = domain.transitions(spark, sf)
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    every = hits.select("node", F.lit(0).alias("hop"), "score").union(hits.join(near, "node").select("other", F.lit(1), "score"))
    best = every.groupBy("node").agg(F.min("hop").alias("hop"), F.max("score").alias("score"))
    skills = domain.requires(spark, sf).groupBy(F.col("occupation").alias("node")).agg(F.count("*").alias("skills"))
    return best.join(skills, "node", "left").select("node", "hop", "score", F.coalesce("skills", F.lit(0)).alias("skills"))


@query("rank_diagnosis", ctes(*_BOTH, "gold", body=_SCALED + " SELECT g.qid, g.doc_id, b.rank AS before, m.rank AS after FROM gold g LEFT JOIN bm25 b USING (qid, doc_id) LEFT JOIN minmaxed m USING (qid, doc_id)"))
def rank_diagnosis(spark, sf):
    """Each reference's rank before and after fusion."""
    before = _bm25(spark, sf).select("qid", "doc_id", F.col("rank").alias("before"))
    after = _fused(spark, sf).select("qid", "doc_id", F.col("rank").alias("after"))
    return domain.gold(spark, sf).join(before, ["qid", "doc_id"], "left").join(after, ["qid", "doc_id"], "left")


@query("rerank_without", ctes(*_CHANNELS, body="""
, kept AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM bm25 WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT qid, doc_id, rank FROM kept WHERE rank <= 5 AND qid IN (SELECT qid FROM kept WHERE rank = 5)"""))
def rerank_without(spark, sf):
    """A list without excluded documents; questions with too few candidates give no partial list."""
    excluded = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    kept = _bm25(spark, sf).join(excluded, "doc_id", "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 5")
    full = kept.where("rank = 5").select("qid")
    return kept.join(full, "qid", "left_semi").select("qid", "doc_id", "rank")


@query("entity_facts", ctes("requires", body="""
, m AS (SELECT n_name AS entity, s_suppkey AS occupation, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS i FROM nation JOIN supplier ON s_nationkey = n_nationkey),
f AS (SELECT entity, occupation, skill, row_number() OVER (PARTITION BY occupation ORDER BY importance DESC, skill) AS r FROM m JOIN requires USING (occupation) WHERE i <= 2)
SELECT entity, occupation, string_agg(skill, ',' ORDER BY r) AS facts FROM f WHERE r <= 3 GROUP BY ALL"""))
def entity_facts(spark, sf):
    """Up to two entities of each mention with their foremost facts."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("entity"))
    first = Window.partitionBy("entity").orderBy("s_suppkey")
    m = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(nations, "s_nationkey").withColumn("i", F.row_number().over(first)).where("i <= 2").select("entity", F.col("s_suppkey").alias("occupation"))
    f = m.join(domain.requires(spark, sf), "occupation").withColumn("r", F.row_number().over(Window.partitionBy("occupation").orderBy(F.desc("importance"), "skill"))).where("r <= 3")
    return f.groupBy("entity", "occupation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "skill"))), lambda x: x.skill.cast("string")), ",").alias("facts"))


@query("front_matter_check", """SELECT page_id FROM pages WHERE NOT regexp_matches(html, '(?i)<title') OR NOT regexp_matches(html, '(?i)<html[^>]*lang="(en|de|es)"') OR url = ''""")
def front_matter_check(spark, sf):
    """Pages that lack a required field or state a language that is not listed."""
    return table(spark, sf, "pages").where(~F.col("html").rlike("(?i)<title") | ~F.col("html").rlike('(?i)<html[^>]*lang="(en|de|es)"') | (F.col("url") == "")).select("page_id")


@query("vector_ranges", "SELECT label, count(*) AS vectors, min(len(embedding)) AS least, max(len(embedding)) AS most FROM embeddings GROUP BY label")
def vector_ranges(spark, sf):
    """Cached vectors by class."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"))


@query("max_score_merge", ctes(*_BOTH, body="""
, s AS (SELECT qid // 2 AS qid, doc_id, max(score) AS score FROM dense GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""))
def max_score_merge(spark, sf):
    """Sub-queries merged by their best score."""
    merged = _dense(spark, sf).groupBy(F.floor(F.col("qid") / 2).alias("qid"), "doc_id").agg(F.max("score").alias("score"))
    return retrieval.top(merged, 10)


@query("richness", r"SELECT doc_id, floor((length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) - 1.5::DOUBLE * length(regexp_replace(text, '[^0-9]', '', 'g'))) / greatest(1, length(text)) * 10000 + 0.5) / 10000 AS richness FROM documents")
def richness(spark, sf):
    """Text statistics: prose against figures."""
    prose, digits = F.length(F.regexp_replace("text", "[^A-Za-z ]", "")), F.length(F.regexp_replace("text", "[^0-9]", ""))
    return table(spark, sf, "documents").select("doc_id", T.half_up((prose - 1.5 * digits) / F.greatest(F.lit(1), F.length("text")), 4).alias("richness"))
