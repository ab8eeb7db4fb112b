"""Queries of the property graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import half_up
from tessera.operators import graph, viewport
from tessera.operators.ordering import numbered, within
from tessera.plans.registry import query
from tessera.sources import domain
from tessera.sources.domain import ctes, table

_CLOSURE = """,
walk AS (SELECT DISTINCT src, dst, 1 AS depth FROM prerequisites
  UNION ALL SELECT DISTINCT w.src, p.dst, w.depth + 1 FROM walk w JOIN prerequisites p ON w.dst = p.src),
closure AS (SELECT src, dst, max(depth) AS depth FROM walk GROUP BY ALL)"""


def _recursive(*names: str, body: str) -> str:
    return ctes(*names, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("node_kinds", ctes("nodes", body=" SELECT kind, count(*) AS nodes, count(DISTINCT label) AS labels FROM nodes GROUP BY kind"))
def node_kinds(spark, sf):
    """Nodes and labels by kind."""
    return domain.nodes(spark, sf).groupBy("kind").agg(F.count("*").alias("nodes"), F.countDistinct("label").alias("labels"))


@query("edge_types", ctes("requires", "prerequisites", "transitions", body="""
SELECT 'requires' AS type, count(*) AS edges FROM requires UNION ALL SELECT 'prerequisite', count(*) FROM prerequisites
UNION ALL SELECT 'transitions_to', count(*) FROM transitions UNION ALL SELECT 'belongs_to', count(*) FROM part"""))
def edge_types(spark, sf):
    """Edges by type."""
    parts = {"requires": domain.requires(spark, sf), "prerequisite": domain.prerequisites(spark, sf), "transitions_to": domain.transitions(spark, sf), "belongs_to": table(spark, sf, "part")}
    found = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("type"), F.count("*").alias("edges"))
        found = row if found is None else found.union(row)
    return found


@query("edge_endpoints", ctes("requires", body="""
SELECT s_name AS occupation, p_name AS skill, p_brand AS domain, target_level, floor(importance * 1000 + 0.5) / 1000 AS weight
FROM requires JOIN supplier ON occupation = s_suppkey JOIN part ON skill = p_partkey"""))
def edge_endpoints(spark, sf):
    """Edges with both of their nodes, weights at three digits."""
    occupations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("occupation"), "s_name")
    skills = table(spark, sf, "part").select(F.col("p_partkey").alias("skill"), "p_name", "p_brand")
    joined = domain.requires(spark, sf).join(occupations, "occupation").join(skills, "skill")
    return joined.select(F.col("s_name").alias("occupation"), F.col("p_name").alias("skill"), F.col("p_brand").alias("domain"), "target_level", half_up("importance", 3).alias("weight"))


@query("occupation_domains", ctes("requires", body=" SELECT DISTINCT occupation, p_brand AS domain FROM requires JOIN part ON skill = p_partkey"))
def occupation_domains(spark, sf):
    """Occupation, required skill, domain, distinct."""
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("skill"), F.col("p_brand").alias("domain"))
    return domain.requires(spark, sf).join(brands, "skill").select("occupation", "domain").distinct()


@query("skill_tasks", "SELECT l_partkey AS skill, count(DISTINCT l_orderkey) AS tasks FROM lineitem GROUP BY 1")
def skill_tasks(spark, sf):
    """Tasks that train each skill."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("skill")).agg(F.countDistinct("l_orderkey").alias("tasks"))


@query("edge_keys", ctes("transitions", body=" SELECT 'transitions_to|occupation:' || src || '|occupation:' || dst AS key, printf('e-%04d', row_number() OVER (ORDER BY src, dst)) AS id FROM transitions"))
def edge_keys(spark, sf):
    """Typed keys and sequence ids."""
    key = F.concat(F.lit("transitions_to|occupation:"), F.col("src").cast("string"), F.lit("|occupation:"), F.col("dst").cast("string"))
    return numbered(domain.transitions(spark, sf), ["src", "dst"]).select(key.alias("key"), F.format_string("e-%04d", "number").alias("id"))


@query("neighbors_1hop", ctes("nodes", "requires", "prerequisites", "transitions", "typed_edges", body=" SELECT src AS node, count(*) AS neighbours, min(dst) AS first FROM adjacency GROUP BY 1"))
def neighbors_1hop(spark, sf):
    """Undirected neighbours over all types of edges, without references to evidence."""
    return graph.neighbours(domain.typed_edges(spark, sf), domain.nodes(spark, sf).select(F.col("id").alias("node")), domain.edge_tasks(spark, sf))


@query("degrees", ctes("prerequisites", body="""
SELECT node, CAST(sum(i) AS BIGINT) AS degree_in, CAST(sum(o) AS BIGINT) AS degree_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM prerequisites UNION ALL SELECT dst, 1, 0 FROM prerequisites) GROUP BY node"""))
def degrees(spark, sf):
    """In- and out-degrees."""
    return graph.degrees(domain.prerequisites(spark, sf))


@query("hops_k", _recursive("transitions", body=""",
near AS (SELECT src, dst FROM transitions UNION SELECT dst, src FROM transitions),
walk AS (SELECT DISTINCT src AS seed, src AS node, 0 AS hop FROM near
  UNION ALL SELECT DISTINCT seed, dst, hop + 1 FROM walk JOIN near ON node = src WHERE hop < 3)
SELECT seed, node, min(hop) AS hop FROM walk GROUP BY ALL"""))
def hops_k(spark, sf):
    """Distances up to three steps from every node."""
    edges = domain.transitions(spark, sf)
    seeds = graph.undirected(edges).select(F.col("src").alias("seed"))
    return graph.hops(edges, seeds, 3)


@query("prereq_closure", _recursive("prerequisites", body=_CLOSURE + " SELECT src, dst, depth FROM closure"))
def prereq_closure(spark, sf):
    """All pairs of the transitive closure with the longest way."""
    return graph.closure(domain.prerequisites(spark, sf))


@query("prereq_depth", _recursive("prerequisites", body=_CLOSURE + " SELECT p_partkey AS node, coalesce(max(depth), 0) AS depth FROM part LEFT JOIN closure ON dst = p_partkey GROUP BY 1"))
def prereq_depth(spark, sf):
    """Longest-way depth of each skill."""
    return graph.depths(table(spark, sf, "part").select(F.col("p_partkey").alias("node")), domain.prerequisites(spark, sf))


@query("learning_order", _recursive("prerequisites", body=_CLOSURE + """,
d AS (SELECT p_partkey AS node, p_brand AS domain, coalesce(max(depth), 0) AS depth FROM part LEFT JOIN closure ON dst = p_partkey GROUP BY ALL)
SELECT domain, node, depth, row_number() OVER (PARTITION BY domain ORDER BY depth, node) AS step FROM d"""))
def learning_order(spark, sf):
    """A topological order of each domain's skills."""
    skills = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("domain"))
    found = graph.depths(skills, domain.prerequisites(spark, sf)).join(skills, "node").withColumn("_order", F.struct("depth", "node"))
    return within(found, "domain", "_order", "step").select("domain", "node", "depth", "step")


@query("cycle_nodes", ctes("prerequisites", body="""
, tops AS (SELECT p_partkey FROM part WHERE ceil(p_size / 10.0) = 2 AND p_partkey % 3 = 0),
e AS (SELECT src, dst FROM prerequisites UNION SELECT dst, src FROM prerequisites JOIN tops ON src = p_partkey)
SELECT DISTINCT src AS node FROM prerequisites JOIN tops ON src = p_partkey UNION SELECT DISTINCT dst FROM prerequisites JOIN tops ON src = p_partkey"""))
def cycle_nodes(spark, sf):
    """Nodes on cycles or between them, by peeling, after edges back into a third of tier 2 are added."""
    edges = domain.prerequisites(spark, sf)
    back = table(spark, sf, "part").where("ceil(p_size / 10) = 2 and p_partkey % 3 = 0").select(F.col("p_partkey").alias("src"))
    return graph.peeled(edges.union(edges.join(back, "src", "left_semi").select("dst", "src")))


_BACK = """
, back AS (SELECT src, dst FROM prerequisites UNION SELECT dst, src FROM prerequisites WHERE dst % 40 = 0),
walk AS (SELECT src, dst FROM back UNION SELECT w.src, b.dst FROM walk w JOIN back b ON w.dst = b.src)"""


def _turned_back(spark, sf):
    """The prerequisites, and those that end at a skill divisible by 40 the other way round as well."""
    edges = domain.prerequisites(spark, sf)
    return edges.union(edges.where("dst % 40 = 0").select("dst", "src"))


@query("acyclic_check", _recursive("prerequisites", body=_BACK + """,
walk_given AS (SELECT src, dst FROM prerequisites UNION SELECT w.src, p.dst FROM walk_given w JOIN prerequisites p ON w.dst = p.src)
SELECT kind, count(DISTINCT node) AS nodes, CASE WHEN count(node) = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT 'given' AS kind, node FROM (SELECT 1) LEFT JOIN (SELECT src AS node FROM walk_given WHERE src = dst) ON true
  UNION ALL SELECT 'with back edges', node FROM (SELECT 1) LEFT JOIN (SELECT src AS node FROM walk WHERE src = dst) ON true) GROUP BY kind"""))
def acyclic_check(spark, sf):
    """C4: nodes on cycles, in the prerequisite graph, which has none, and in one with some edges turned back."""
    found = None
    for kind, graph_of in (("given", domain.prerequisites(spark, sf)), ("with back edges", _turned_back(spark, sf))):
        n = graph.cyclic(graph_of).agg(F.count("*").alias("nodes"))
        row = n.select(F.lit(kind).alias("kind"), "nodes", F.when(F.col("nodes") == 0, "pass").otherwise("fail").alias("status"))
        found = row if found is None else found.union(row)
    return found


@query("strong_components", _recursive("prerequisites", body=_BACK + """
SELECT p_partkey AS node, least(p_partkey, coalesce(min(a.dst), p_partkey)) AS component FROM part LEFT JOIN (walk a JOIN walk b ON a.src = b.dst AND a.dst = b.src) ON a.src = p_partkey GROUP BY p_partkey"""))
def strong_components(spark, sf):
    """The strongly connected component of each skill, named by its smallest one, with some edges turned back."""
    return graph.components(_turned_back(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("node")))


@query("condensed_depth", _recursive("prerequisites", body=_BACK + """,
comp AS (SELECT p_partkey AS node, least(p_partkey, coalesce(min(a.dst), p_partkey)) AS component FROM part LEFT JOIN (walk a JOIN walk b ON a.src = b.dst AND a.dst = b.src) ON a.src = p_partkey GROUP BY p_partkey),
links AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM back JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.component <> b.component),
far AS (SELECT src, dst, 1 AS depth FROM links UNION SELECT f.src, l.dst, depth + 1 FROM far f JOIN links l ON f.dst = l.src)
SELECT node, coalesce(depth, 0) AS depth FROM comp LEFT JOIN (SELECT dst, max(depth) AS depth FROM far GROUP BY dst) ON dst = component"""))
def condensed_depth(spark, sf):
    """The longest way to each skill when those on a cycle are taken as one."""
    edges = _turned_back(spark, sf)
    own = graph.components(edges, table(spark, sf, "part").select(F.col("p_partkey").alias("node")))
    far = graph.depths(own.select(F.col("component").alias("node")), graph.condensed(edges, own))
    return own.join(far.withColumnRenamed("node", "component"), "component").select("node", "depth")


@query("cycle_witness", _recursive("prerequisites", body=_BACK + """,
start AS (SELECT min(src) AS node FROM walk WHERE src = dst),
ahead AS (SELECT src AS node, 0 AS step FROM start JOIN back ON src = node UNION SELECT dst, step + 1 FROM ahead JOIN back ON src = node WHERE step < 12),
levels AS (SELECT node, min(step) FILTER (step > 0 OR node <> (SELECT node FROM start)) AS step FROM ahead GROUP BY node UNION ALL SELECT node, 0 FROM start),
path AS (SELECT node, step FROM levels WHERE node = (SELECT node FROM start) AND step > 0
  UNION ALL SELECT (SELECT min(l.node) FROM levels l JOIN back b ON b.src = l.node AND b.dst = p.node WHERE l.step = p.step - 1), step - 1 FROM path p WHERE step > 0)
SELECT step, node FROM path WHERE step < (SELECT max(step) FROM path)"""))
def cycle_witness(spark, sf):
    """A shortest cycle through the smallest skill that lies on one, in order."""
    return graph.witness(_turned_back(spark, sf))


@query("stage_promotion", _recursive("prerequisites", body=_CLOSURE + """
, own AS (SELECT p_partkey AS node, CAST(p_partkey % 3 + 1 AS INTEGER) AS stage FROM part)
SELECT o.node, greatest(o.stage, coalesce(max(p.stage), 0)) AS stage FROM own o LEFT JOIN closure c ON c.dst = o.node LEFT JOIN own p ON p.node = c.src GROUP BY o.node, o.stage"""))
def stage_promotion(spark, sf):
    """No skill stands in an earlier stage than what it needs."""
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 3 + 1).cast("int").alias("value"))
    return graph.relaxed(own, domain.prerequisites(spark, sf)).withColumnRenamed("value", "stage")


@query("grid_layout", ctes("nodes", body="""
, placed AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS i FROM nodes),
bands AS (SELECT kind, (max(i) // 5) + 1 AS rows_ FROM placed GROUP BY kind),
tops AS (SELECT kind, coalesce(sum(rows_) OVER (ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM bands)
SELECT id, CAST(i % 5 * 100 AS BIGINT) AS x, CAST((top + i // 5) * 80 AS BIGINT) AS y FROM placed JOIN tops USING (kind)"""))
def grid_layout(spark, sf):
    """A band of rows for each kind, five nodes in a row."""
    placed = within(domain.nodes(spark, sf).select("id", "kind"), "kind", "id").withColumn("i", F.col("at") - 1)
    bands = placed.groupBy("kind").agg((F.floor(F.max("i") / 5) + 1).alias("rows"))
    above = Window.partitionBy(F.lit(0)).orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    tops = bands.select("kind", F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("top"))
    return placed.join(tops, "kind").select("id", (F.col("i") % 5 * 100).cast("long").alias("x"), ((F.col("top") + F.floor(F.col("i") / 5)) * 80).cast("long").alias("y"))


_LAID = ctes("nodes", "requires", "prerequisites", "transitions", "typed_edges", body="""
, placed AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS i FROM nodes),
bands AS (SELECT kind, (max(i) // 5) + 1 AS rows_ FROM placed GROUP BY kind),
tops AS (SELECT kind, coalesce(sum(rows_) OVER (ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM bands),
laid AS (SELECT id, CAST(i % 5 * 100 AS DOUBLE) AS x, CAST((top + i // 5) * 80 AS DOUBLE) AS y FROM placed JOIN tops USING (kind))""")


@query("camera_fit", _LAID + """
SELECT (min(x) + max(x)) / 2 AS x, (min(y) + max(y)) / 2 AS y, least(1.0::DOUBLE, 1200.0::DOUBLE / (max(x) - min(x) + 80), 800.0::DOUBLE / (max(y) - min(y) + 80)) AS scale FROM laid""")
def camera_fit(spark, sf):
    """The middle and scale at which the whole layout fits a view."""
    return viewport.camera(grid_layout(spark, sf), 1200, 800, 40)


@query("clipped_edges", _LAID + """,
e AS (SELECT type, src, dst, a.x AS x0, a.y AS y0, b.x - a.x AS dx, b.y - a.y AS dy FROM typed_edges JOIN laid a ON a.id = src JOIN laid b ON b.id = dst),
t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, CASE WHEN dx = 0 THEN 'inf'::DOUBLE ELSE 40 / abs(dx) END, CASE WHEN dy = 0 THEN 'inf'::DOUBLE ELSE 15 / abs(dy) END) END AS t FROM e),
c AS (SELECT type, src, dst, x0 + dx * t AS x0, y0 + dy * t AS y0, x0 + dx - dx * t AS x1, y0 + dy - dy * t AS y1 FROM t),
d AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM c),
s AS (SELECT *, greatest(0.0::DOUBLE, CASE WHEN dx > 0 THEN (50 - x0) / dx WHEN dx < 0 THEN (350 - x0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (100 - y0) / dy WHEN dy < 0 THEN (2100 - y0) / dy ELSE 0 END) AS i,
  least(1.0::DOUBLE, CASE WHEN dx > 0 THEN (350 - x0) / dx WHEN dx < 0 THEN (50 - x0) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (2100 - y0) / dy WHEN dy < 0 THEN (100 - y0) / dy ELSE 1 END) AS o FROM d)
SELECT type, count(*) AS edges, floor(sum(floor((x0 + dx * i + x0 + dx * o) * 100 + 0.5)) / 1000 + 0.5) AS xs, floor(sum(floor((y0 + dy * i + y0 + dy * o) * 100 + 0.5)) / 1000 + 0.5) AS ys
FROM s WHERE i <= o AND NOT (dx = 0 AND (x0 < 50 OR x0 > 350)) AND NOT (dy = 0 AND (y0 < 100 OR y0 > 2100)) GROUP BY type""")
def clipped_edges(spark, sf):
    """All edges cut at their nodes' boxes and at a view of the layout: how many are seen, and a sum of their ends by type."""
    at = grid_layout(spark, sf).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = [at.toDF(end, f"x{i}", f"y{i}") for i, end in enumerate(("src", "dst"))]
    edges = domain.typed_edges(spark, sf).join(ends[0], "src").join(ends[1], "dst")
    seen = viewport.clipped(viewport.trimmed(edges, 40, 15), 50, 100, 350, 2100)
    total = [F.floor(F.sum(F.floor((F.col(f"{c}0") + F.col(f"{c}1")) * 100 + 0.5)) / 1000 + 0.5).cast("double").alias(f"{c}s") for c in "xy"]
    return seen.groupBy("type").agg(F.count("*").alias("edges"), *total)


@query("bounding_boxes", "SELECT p_brand AS domain, min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part GROUP BY 1")
def bounding_boxes(spark, sf):
    """The box of each domain's skills."""
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("domain")).agg(F.min("p_size").alias("x0"), F.max("p_size").alias("x1"), F.min("p_retailprice").alias("y0"), F.max("p_retailprice").alias("y1"))


@query("cascade_delete", ctes("prerequisites", body=" SELECT src, dst FROM prerequisites WHERE src IN (SELECT p_partkey FROM part WHERE p_size <> 7) AND dst IN (SELECT p_partkey FROM part WHERE p_size <> 7)"))
def cascade_delete(spark, sf):
    """Edges whose two nodes remain."""
    kept = table(spark, sf, "part").where("p_size <> 7").select(F.col("p_partkey").alias("node"))
    edges = domain.prerequisites(spark, sf)
    return edges.join(kept, F.col("src") == F.col("node"), "left_semi").join(kept, F.col("dst") == F.col("node"), "left_semi")


@query("dangling_refs", ctes("prerequisites", body="""
SELECT src, dst, 'src' AS missing FROM prerequisites WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0)
UNION ALL SELECT src, dst, 'dst' FROM prerequisites WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0)"""))
def dangling_refs(spark, sf):
    """Edge ends that no node has, after some nodes are rejected."""
    return graph.dangling(domain.prerequisites(spark, sf), table(spark, sf, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("node")))


@query("edge_endpoint_check", """
SELECT l_orderkey AS src, l_partkey AS dst, p_type AS found FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderpriority = '1-URGENT' AND p_type NOT IN (SELECT p_type FROM part WHERE p_size < 25 AND p_type <> 'ECONOMY')""")
def edge_endpoint_check(spark, sf):
    """Edges whose end is of no allowed kind."""
    part = table(spark, sf, "part")
    allowed = part.where("p_size < 25 and p_type <> 'ECONOMY'").select("p_type").distinct()
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(urgent, "l_orderkey", "left_semi")
    odd = part.select(F.col("p_partkey").alias("l_partkey"), "p_type").join(allowed, "p_type", "left_anti")
    return items.join(odd, "l_partkey").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("p_type").alias("found"))


@query("page_edge_projection", ctes("transitions", body="""
SELECT 'page only' AS side, p.s_suppkey AS src, p.n AS dst FROM (SELECT s_suppkey, s_suppkey + 1 AS n FROM supplier WHERE s_suppkey % 4 = 0) p WHERE NOT EXISTS (FROM transitions t WHERE t.src = s_suppkey AND t.dst = n)
UNION ALL SELECT 'edge only', src, dst FROM transitions WHERE NOT (src % 4 = 0 AND dst = src + 1)"""))
def page_edge_projection(spark, sf):
    """Links of pages without an edge, and edges without a link."""
    edges = domain.transitions(spark, sf)
    links = table(spark, sf, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"))
    return links.join(edges, ["src", "dst"], "left_anti").select(F.lit("page only").alias("side"), "src", "dst").union(edges.join(links, ["src", "dst"], "left_anti").select(F.lit("edge only"), "src", "dst"))
