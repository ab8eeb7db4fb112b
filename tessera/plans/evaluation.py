"""Queries of the evaluation lab in full: gates, expansions, provenance, question sets, alignment and chunking."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.functions import text as T
from tessera.operators import alignment, anchors, graph, intervals, metrics, picking, retrieval, text_index
from tessera.operators.checkpoints import settled
from tessera.plans.registry import query
from tessera.plans.retrieval import _BOTH, _CHANNELS, _PEAK, _SCALED, _bm25, _dense, _docs, _fused, _position, _ranked
from tessera.sources import domain
from tessera.sources.domain import SQL, ctes, table

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9+._#-]*')"


def _renamed(prefix: str, **names: str) -> str:
    """The SQL of postings and bm25 over other tables; ``names`` maps table names."""
    own = {n: f"{prefix}_{n}" for n in ("tokens", "postings", "sizes", "stats", "frequencies", "scored", "bm25")} | names
    return re.sub(r"\b(" + "|".join(own) + r")\b(?! AS \()", lambda m: own[m[1]], re.sub(r"\b(tokens|postings|sizes|stats|frequencies|scored|bm25) AS \(", lambda m: own[m[1]] + " AS (", SQL["postings"] + ",\n" + SQL["bm25"]))


@query("language_gates", ctes(*_BOTH, body=_SCALED + _PEAK + r""",
gates AS (SELECT item_id AS qid, CASE WHEN length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) >= 0.2::DOUBLE * length(regexp_replace(text, '\s+', '', 'g')) THEN 'han' WHEN NOT regexp_matches(text, '[A-Za-z]{4,}') OR coalesce(peak, 0) < 1.5 THEN 'flat' ELSE 'latin' END AS gate FROM benchmark LEFT JOIN peaks ON qid = item_id)
SELECT qid, gate, doc_id, rank FROM gates JOIN (SELECT qid, doc_id, rank, 'latin' AS gate FROM bm25 UNION ALL SELECT qid, doc_id, rank, 'han' FROM dense UNION ALL SELECT qid, doc_id, rank, 'flat' FROM minmaxed) USING (qid, gate) WHERE rank <= 10"""))
def language_gates(spark, sf):
    """Han questions go to vectors, Latin ones of a sharp peak to words, the others to both."""
    # DEPTH rows a question each; settled, as they are read several times.
    lexical, dense = settled(_bm25(spark, sf)), settled(_dense(spark, sf))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text").join(retrieval.peak_ratio(lexical), "qid", "left")
    gate = F.when(T.han_ratio("text") >= 0.2, "han").when(~F.col("text").rlike("[A-Za-z]{4,}") | (F.coalesce("peak", F.lit(0.0)) < 1.5), "flat").otherwise("latin")
    runs = [x.select("qid", "doc_id", "rank", F.lit(g).alias("gate")) for x, g in ((lexical, "latin"), (dense, "han"), (_fused(spark, sf, lexical, dense), "flat"))]
    return runs[0].union(runs[1]).union(runs[2]).where("rank <= 10").join(asked.select("qid", gate.alias("gate")), ["qid", "gate"]).select("qid", "gate", "doc_id", "rank")


@query("refusal_cosine", ctes("dense", "gold", body="""
, signals AS (SELECT d.qid, d.score AS signal, d.qid % 4 <> 0 AS answerable FROM dense d WHERE rank = 1)
SELECT t::DOUBLE AS threshold, count(*) FILTER (NOT answerable AND signal < t) AS rejected, count(*) FILTER (answerable AND signal < t) AS false_rejects,
  floor(((count(*) FILTER (NOT answerable AND signal < t))::DOUBLE / (count(*) FILTER (NOT answerable)) + 1 - (count(*) FILTER (answerable AND signal < t))::DOUBLE / (count(*) FILTER (answerable))) / 2 * 10000 + 0.5) / 10000 AS balanced_accuracy
FROM signals CROSS JOIN (SELECT unnest([0.3::DOUBLE, 0.35::DOUBLE, 0.4::DOUBLE, 0.45::DOUBLE, 0.5::DOUBLE]) AS t) GROUP BY t"""))
def refusal_cosine(spark, sf):
    """Refuse where the largest cosine is below a threshold; a quarter of the questions counts as out of scope."""
    signal = _dense(spark, sf, 1).select("qid", F.col("score").alias("signal"), (F.col("qid") % 4 != 0).alias("answerable"))
    return metrics.threshold_sweep(signal, [0.3, 0.35, 0.4, 0.45, 0.5])


_HEADING = "split_part(text, chr(10), 1)"


@query("field_weighted_search", f"WITH documents AS (SELECT doc_id, {_HEADING} || ' ' || {_HEADING} || ' ' || {_HEADING} || ' ' || text AS text FROM main.documents), " + ctes(*_CHANNELS, body=" SELECT qid, doc_id, score, rank FROM bm25 WHERE rank <= 3")[5:])
def field_weighted_search(spark, sf):
    """BM25 over texts whose heading counts three times more."""
    heading = F.element_at(F.split("text", "\n"), 1)
    docs = _docs(spark, sf).select("doc_id", F.concat_ws(" ", heading, heading, heading, "text").alias("text"))
    return retrieval.bm25(docs, domain.questions(spark, sf), 3)


_NODES = ("nodes", "node_texts", "requires", "prerequisites", "transitions", "typed_edges")


@query("graph_expanded_search", ctes("questions", "postings", *_NODES, body=f""",
node_docs AS (SELECT id AS doc_id, label || ' ' || array_to_string(aliases, ' ') || ' ' || description AS text FROM node_texts),
{_renamed("n", documents="node_docs")},
seeds AS (SELECT qid, doc_id AS id FROM n_bm25 WHERE rank <= 3),
hood AS (SELECT qid, id FROM seeds UNION SELECT qid, dst FROM seeds JOIN adjacency ON src = id),
expanded AS (SELECT qid, term FROM questions UNION ALL SELECT qid, unnest({_TOKENS.format("label || ' ' || array_to_string(aliases, ' ')")}) FROM hood JOIN node_texts USING (id)),
{_renamed("x", questions="expanded")}
SELECT qid, doc_id, score, rank FROM x_bm25 WHERE rank <= 3"""))
def graph_expanded_search(spark, sf):
    """Nodes whose label, aliases and description fit the question, those one typed edge away, and the search with all of their names."""
    texts = domain.node_texts(spark, sf)
    names = F.concat_ws(" ", "label", F.concat_ws(" ", "aliases"))
    fits = texts.select(F.col("id").alias("doc_id"), F.concat_ws(" ", names, "description").alias("text"))
    seeds = retrieval.bm25(fits, domain.questions(spark, sf), 3).select("qid", F.col("doc_id").alias("id"))
    near = graph.adjacency(domain.typed_edges(spark, sf), texts.select(F.col("id").alias("node")), tasks=domain.edge_tasks(spark, sf))
    hood = seeds.union(seeds.join(near, F.col("id") == F.col("src")).select("qid", F.col("dst").alias("id"))).distinct()
    added = hood.join(texts.select("id", names.alias("text")), "id").select("qid", F.explode(T.latin_tokens("text")).alias("term"))
    return _ranked(spark, sf, domain.questions(spark, sf).select("qid", "term").union(added), 3)


_CHILDREN = """
, child_docs AS (SELECT doc_id * 100000 + pos AS doc_id, text FROM chunks),
""" + _renamed("c", documents="child_docs") + """,
children AS (SELECT qid, s.doc_id AS child, s.doc_id // 100000 AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, s.doc_id) AS rank FROM c_scored s),
placed_children AS (SELECT c.*, k.start // 1600 AS part, k."end" - k.start AS chars, k.text FROM children c JOIN chunks k ON k.doc_id * 100000 + k.pos = c.child WHERE rank <= 50),
parents AS (SELECT qid, doc_id, part, max(score) AS score, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, doc_id, part) AS rank FROM placed_children GROUP BY qid, doc_id, part),
contexts AS (SELECT p.qid, p.rank, p.doc_id, p.part, count(*) AS children, CAST(sum(k."end" - k.start) AS BIGINT) AS chars, md5(string_agg(k.text, chr(10) ORDER BY k.pos)) AS context FROM parents p JOIN chunks k ON k.doc_id = p.doc_id AND k.start // 1600 = p.part WHERE p.rank <= 3 GROUP BY ALL)"""


def _children(spark, sf):
    """The chunks of the documents that the 50 best chunks of each question lie in, and those best ones."""
    every = domain.chunks(spark, sf).select((F.col("doc_id") * 100000 + F.col("pos")).alias("doc_id"), "text")
    index = text_index.index_of(spark, f"{sf}/documents.parquet", every, what="chunks")
    # 50 rows a question; settled, as they are read several times.
    found = settled(text_index.search(index, retrieval.asked_of(domain.questions(spark, sf)), 50).withColumnRenamed("doc_id", "child"))
    near = domain.chunks(spark, sf, found.select(F.floor(F.col("child") / 100000).alias("doc_id")))
    chunks = near.withColumns({"child": F.col("doc_id") * 100000 + F.col("pos"), "part": F.floor(F.col("start") / 1600), "chars": F.col("end") - F.col("start")})
    return chunks, found.join(chunks.select("child", "doc_id", "part", "chars"), "child")


def _contexts(spark, sf):
    chunks, found = _children(spark, sf)
    best = found.groupBy("qid", "doc_id", "part").agg(F.max("score").alias("score"))
    parents = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "part"))).where("rank <= 3").drop("score")
    whole = parents.join(chunks.select("doc_id", "part", "pos", "chars", "text"), ["doc_id", "part"]).groupBy("qid", "rank", "doc_id", "part")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "\n")
    return found, whole.agg(F.count("*").alias("children"), F.sum("chars").alias("chars"), F.md5(text).alias("context"))


@query("parent_contexts", ctes("questions", "chunks", body=_CHILDREN + " SELECT * FROM contexts"))
def parent_contexts(spark, sf):
    """Parents by their best child, with all of their children's texts in order."""
    return _contexts(spark, sf)[1]


@query("budget_control", ctes("questions", "chunks", body=_CHILDREN + """,
budgets AS (SELECT qid, sum(chars) AS budget FROM contexts GROUP BY qid),
taken AS (SELECT qid, chars, doc_id, sum(chars) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM placed_children)
SELECT t.qid, CAST(budget AS BIGINT) AS budget, count(*) AS children, CAST(sum(chars) AS BIGINT) AS chars, count(DISTINCT doc_id) AS documents FROM taken t JOIN budgets b USING (qid) WHERE upto <= budget GROUP BY ALL"""))
def budget_control(spark, sf):
    """As many of the best children as the parents' characters pay for."""
    found, contexts = _contexts(spark, sf)
    budgets = contexts.groupBy("qid").agg(F.sum("chars").alias("budget"))
    upto = F.sum("chars").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    taken = found.withColumn("upto", upto).join(budgets, "qid").where("upto <= budget")
    return taken.groupBy("qid", "budget").agg(F.count("*").alias("children"), F.sum("chars").alias("chars"), F.countDistinct("doc_id").alias("documents"))


_USED = """,
used AS (SELECT g.qid, g.doc_id, strpos(d.text, b.text) - 1 AS s, strpos(d.text, b.text) - 1 + length(b.text) AS e FROM gold g JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = g.qid)"""


def _used(spark, sf):
    """qid, doc_id, s and e: where a question's passage stands in the documents that have it."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    found = domain.gold(spark, sf).join(items, "qid").join(_docs(spark, sf), "doc_id")
    at = F.expr("locate(passage, text) - 1")
    return found.select("qid", "doc_id", at.cast("long").alias("s"), (at + F.length("passage")).cast("long").alias("e"))


@query("holdout_chunks", ctes("chunks", "gold", body=_USED + """
SELECT doc_id, pos FROM chunks c WHERE doc_id IN (SELECT doc_id FROM used) AND NOT EXISTS (FROM used u WHERE u.doc_id = c.doc_id AND u.s < c."end" AND c.start < u.e)"""))
def holdout_chunks(spark, sf):
    """Chunks of cited documents that overlap no used span."""
    used = _used(spark, sf)
    chunks = domain.chunks(spark, sf).join(used.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "pos", "start", "end")
    taken = intervals.overlapping(used.select("doc_id", "s", "e"), chunks, "doc_id", ("s", "e"), ("start", "end"))
    return chunks.select("doc_id", "pos").join(taken.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti")


@query("anchor_windows", ctes("chunks", "gold", body=_USED + """
SELECT u.qid, u.doc_id, count(*) AS covering, CAST(max(c."end") - min(c.start) AS BIGINT) AS span, CAST(min(c.pos) AS INTEGER) AS first FROM used u JOIN chunks c ON c.doc_id = u.doc_id AND u.s < c."end" AND c.start < u.e GROUP BY ALL"""))
def anchor_windows(spark, sf):
    """The chunks that cover an anchor, and the window from the first one's start to the last one's end."""
    joined = intervals.overlapping(_used(spark, sf), domain.chunks(spark, sf).drop("source", "lang", "text"), "doc_id", ("s", "e"), ("start", "end"))
    return joined.groupBy("qid", "doc_id").agg(F.count("*").alias("covering"), (F.max("end") - F.min("start")).alias("span"), F.min("pos").alias("first"))


@query("smallest_windows", ctes("gold", body=r"""
, words AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(text, '[A-Za-z]{5,}')) AS w FROM benchmark),
anchors AS (SELECT qid, unnest(list_slice(list_sort(w), 1, 3)) AS anchor FROM words),
hits AS (SELECT g.qid, g.doc_id, anchor, i AS s, i + length(anchor) AS e FROM gold g JOIN documents d USING (doc_id) JOIN anchors USING (qid), LATERAL (SELECT unnest(range(0, length(d.text))) AS i) WHERE substr(d.text, i + 1, length(anchor)) = anchor),
n AS (SELECT qid, count(*) AS n FROM anchors GROUP BY qid),
open_ AS (SELECT h.qid, h.doc_id, h.s, h.e, o.anchor, max(o.s) AS place, max(o.e) AS upto FROM hits h JOIN hits o ON o.qid = h.qid AND o.doc_id = h.doc_id AND (o.s < h.s OR (o.s = h.s AND o.anchor <= h.anchor)) GROUP BY ALL),
w AS (SELECT qid, doc_id, s, e, min(place) AS start, max(upto) AS "end", count(*) AS held FROM open_ GROUP BY ALL)
SELECT qid, doc_id, arg_min(start, ("end" - start, start)) AS start, arg_min("end", ("end" - start, start)) AS "end" FROM w JOIN n USING (qid) WHERE held = n GROUP BY ALL"""))
def smallest_windows(spark, sf):
    """The smallest stretch of a cited document that holds three anchors of its question."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.slice(F.array_sort(words), 1, 3).alias("anchors"))
    return anchors.windows(domain.gold(spark, sf).join(asked, "qid").join(_docs(spark, sf), "doc_id"))


@query("chunk_criteria", ctes("gold", body=_USED + """,
sizes AS (SELECT unnest([100, 200, 400, 800]) AS size),
f AS (SELECT size, s // size AS a, (e - 1) // size AS b, s, e FROM used, sizes),
per AS (SELECT size, count(*) AS anchors, count(*) FILTER (a = b) AS covered, count(*) FILTER (b * size - (a + 1) * size >= 0 AND b > a + 1) AS inside, CAST(sum(abs((s + e) // 2 - ((s + e) // 2 // size * size + size // 2))) AS BIGINT) AS off_centre FROM f GROUP BY size)
SELECT *, row_number() OVER (ORDER BY covered DESC, off_centre, size) AS place FROM per"""))
def chunk_criteria(spark, sf):
    """Chunk sizes by how many anchors one chunk covers, how many hold a whole chunk, and how far middles are from a chunk's centre."""
    f = _used(spark, sf).withColumn("size", F.explode(F.array(*map(F.lit, (100, 200, 400, 800)))))
    f = f.withColumns({"a": F.floor(F.col("s") / F.col("size")), "b": F.floor((F.col("e") - 1) / F.col("size")), "m": F.floor((F.col("s") + F.col("e")) / 2)})
    centre = F.floor(F.col("m") / F.col("size")) * F.col("size") + F.floor(F.col("size") / 2)
    per = f.groupBy("size").agg(F.count("*").alias("anchors"), F.count_if(F.col("a") == F.col("b")).alias("covered"), F.count_if(F.col("b") > F.col("a") + 1).alias("inside"), F.sum(F.abs(F.col("m") - centre)).alias("off_centre"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("covered"), "off_centre", "size")))


@query("hash_hypotheses", """
WITH stored AS (SELECT doc_id, text, sha256(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text || '.' END) AS stored FROM documents)
SELECT doc_id, CASE WHEN stored = sha256(text) THEN 'as it is' WHEN stored = sha256(replace(text, chr(10), chr(13) || chr(10))) THEN 'other line ends' ELSE 'changed' END AS verdict FROM stored""")
def hash_hypotheses(spark, sf):
    """Stored digests verified under both kinds of line ends; a third of them is of changed texts."""
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    held = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, crlf).otherwise(F.concat("text", F.lit(".")))
    rows = table(spark, sf, "documents").withColumn("stored", F.sha2(held, 256))
    verdict = F.when(F.col("stored") == F.sha2("text", 256), "as it is").when(F.col("stored") == F.sha2(crlf, 256), "other line ends").otherwise("changed")
    return rows.select("doc_id", verdict.alias("verdict"))


@query("semantic_diff", """
WITH old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 75 = 0 THEN 'none' ELSE o_orderpriority END FROM orders WHERE o_orderkey % 97 <> 0)
SELECT coalesce(o.id, n.o_orderkey) AS id, CASE WHEN n.o_orderkey IS NULL THEN 'gone' WHEN o.status <> n.status_ THEN 'status' ELSE 'priority' END AS first FROM old o LEFT JOIN (SELECT * FROM new) n(o_orderkey, status_, priority_) ON o.id = n.o_orderkey WHERE n.o_orderkey IS NULL OR o.status <> n.status_ OR o.priority <> n.priority_""")
def semantic_diff(spark, sf):
    """What differs between two versions when columns that always change (dates, totals) are left out, and the first such column."""
    stable = ["id", "status", "priority"]
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("changed_at"))
    new = old.where("id % 97 <> 0").withColumns({"status": F.when(F.col("id") % 50 == 0, "X").otherwise(F.col("status")), "priority": F.when(F.col("id") % 75 == 0, "none").otherwise(F.col("priority")), "changed_at": F.expr("changed_at + interval 1 day")})
    only_old, only_new = (a.select(*stable).exceptAll(b.select(*stable)) for a, b in ((old, new), (new, old)))
    both = only_old.join(only_new.toDF("id", "_status", "_priority"), "id", "full")
    first = F.when(F.col("_status").isNull(), "gone").when(F.col("status").isNull(), "new").when(F.col("status") != F.col("_status"), "status").otherwise("priority")
    return both.select("id", first.alias("first"))


_PAIRS = """
WITH p AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS at FROM documents)
SELECT a.source, a.doc_id AS a, b.doc_id AS b, CAST(a.lang <> b.lang AS INTEGER) AS apart, CAST(b.at - a.at AS INTEGER) AS gap, -(a.n_chars + b.n_chars) AS poorness FROM p a JOIN p b ON a.source = b.source AND b.at - a.at BETWEEN 2 AND 4"""


def _pairs(spark, sf):
    at = _position(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    a = at.select("source", F.col("doc_id").alias("a"), F.col("lang").alias("l"), F.col("n_chars").alias("n"), F.col("at").alias("x"), F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("gap"))
    b = at.select("source", F.col("doc_id").alias("b"), "lang", "n_chars", "at")
    joined = a.join(b.withColumnRenamed("source", "_source"), (F.col("source") == F.col("_source")) & (F.col("x") + F.col("gap") == F.col("at")))
    return joined.select("source", "a", "b", (F.col("l") != F.col("lang")).cast("int").alias("apart"), "gap", (-(F.col("n") + F.col("n_chars"))).alias("poorness"))


@query("pair_candidates", _PAIRS)
def pair_candidates(spark, sf):
    """Documents of one source, two to four places apart."""
    return _pairs(spark, sf)


@query("pair_picks")
def pair_picks(spark, sf):
    """Greedy pairs without reuse: of one language first, then near ones, then long ones."""
    return picking.without_reuse(_pairs(spark, sf), ["apart", "gap", "poorness"])


@query("text_alignment", ctes("chunks", body=r"""
, w AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 512) / 432.0)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0),
l AS (SELECT * FROM (SELECT doc_id || ':' || i AS item, regexp_replace(substr(text, i * 432 + 1, 512), '\s+', '', 'g') AS a FROM w) WHERE a <> ''),
r AS (SELECT * FROM (SELECT doc_id || ':' || pos AS other, regexp_replace(text, '\s+', '', 'g') AS b FROM chunks) WHERE b <> ''),
same AS (SELECT item, min(other) AS other, 1.0::DOUBLE AS ratio FROM l JOIN r ON a = b GROUP BY item),
near AS (SELECT item, other, b, least(length(a), length(b)) / greatest(length(a), length(b))::DOUBLE AS ratio FROM l JOIN r ON length(b) >= 0.6 * length(a) AND length(a) >= 0.6 * length(b) AND (contains(a, b) OR contains(b, a)) WHERE item NOT IN (SELECT item FROM same))
SELECT * FROM same UNION ALL SELECT item, arg_max(other, (ratio, length(b), b, other)) AS other, max(ratio) AS ratio FROM near WHERE ratio >= 0.6::DOUBLE GROUP BY item"""))
def text_alignment(spark, sf):
    """Pieces that a store has cut out of the documents aligned with the chunks that hold them or that they hold, by coverage."""
    w = _docs(spark, sf).select("doc_id", F.posexplode(chunking.windows("text", 512, 80)).alias("i", "w"))
    items = w.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("item"), F.col("w.text").alias("text"))
    # The chunks of ``domain.chunks`` without their places, cut by an expression: tasks then have one Python worker each.
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.length("text") >= domain.LEAST_CHUNK)
    chunks = lines.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("other"), "text")
    return alignment.covering(items, chunks)


@query("similar_headings", f"""
WITH h AS (SELECT doc_id, {_HEADING} AS text FROM documents), l AS (SELECT doc_id AS item, text FROM h WHERE doc_id % 50 = 0 AND text <> ''), r AS (SELECT doc_id AS other, text FROM h WHERE text <> ''),
g AS (SELECT text, CASE WHEN length(t) < 2 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) END AS g FROM (SELECT DISTINCT text, regexp_replace(lower(text), '\\s+', '', 'g') AS t FROM h)),
p AS (SELECT item, other, len(list_intersect(x.g, y.g)) / len(x.g)::DOUBLE AS ratio FROM l JOIN g x ON x.text = l.text JOIN r ON length(r.text) * 2 >= length(l.text) AND length(r.text) <= length(l.text) * 2 AND item <> other JOIN g y ON y.text = r.text)
SELECT item, arg_min(other, (-ratio, other)) AS other, max(ratio) AS ratio FROM p WHERE ratio >= 0.6::DOUBLE GROUP BY item""")
def similar_headings(spark, sf):
    """Whole headings of the documents divisible by 50 with the other document whose heading has most of their character pairs."""
    h = _docs(spark, sf).select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("text")).where("text <> ''")
    left, right = h.where("doc_id % 50 = 0").select(F.col("doc_id").alias("item"), "text"), h.select(F.col("doc_id").alias("other"), "text")
    return alignment.nearest(left, right, 0.6)


@query("longest_quotes")
def longest_quotes(spark, sf):
    """The longest text that an answer takes over from the turn before it."""
    said = table(spark, sf, "conversations")
    before = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("b"))
    pairs = said.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("a"), "b")
    return alignment.longest_shared(pairs)


@query("overlapping_chunks", """
WITH w AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 512) / 432.0)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i * 432 AS INTEGER) AS start, CAST(length(substr(text, i * 432 + 1, 512)) AS INTEGER) AS chars, md5(substr(text, i * 432 + 1, 512)) AS text_md5 FROM w""")
def overlapping_chunks(spark, sf):
    """Chunks of 512 characters that overlap by 80."""
    found = _docs(spark, sf).select("doc_id", F.explode(chunking.windows("text", 512, 80)).alias("w"))
    return found.select("doc_id", "w.start", F.length("w.text").alias("chars"), F.md5("w.text").alias("text_md5"))


@query("paragraph_chunks", r"""
WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: trim(x)), lambda x: x <> '')) AS p FROM documents),
c AS (SELECT doc_id, unnest(regexp_extract_all(p, '(?s).{1,800}')) AS c FROM p)
SELECT doc_id, count(*) AS pieces, CAST(sum(length(c)) AS BIGINT) AS chars, CAST(max(length(c)) AS INTEGER) AS longest FROM c GROUP BY doc_id""")
def paragraph_chunks(spark, sf):
    """Paragraphs, cut where they are over 800 characters."""
    found = _docs(spark, sf).select("doc_id", F.explode(chunking.paragraphs("text", 800)).alias("c"))
    return found.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("c")).alias("chars"), F.max(F.length("c")).alias("longest"))


@query("recursive_chunks")
def recursive_chunks(spark, sf):
    """Pieces of at most 400 characters, split at the coarsest separator that is fine enough."""
    return _docs(spark, sf).select("doc_id", F.posexplode(chunking.recursive("text", 400)).alias("at", "piece"))


@query("question_set_rules", ctes("gold", body="""
, refs AS (SELECT qid, count(*) AS n, count(DISTINCT d.source) AS sources, count(*) FILTER (l.doc_id IS NOT NULL) AS labelled FROM gold JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) GROUP BY qid),
same AS (SELECT lower(trim(text)) AS t, min(item_id) AS first FROM benchmark GROUP BY 1)
SELECT item_id AS qid, unnest(list_filter([CASE WHEN length(b.text) < 100 THEN 'short' END, CASE WHEN n IS NULL THEN 'no reference' END, CASE WHEN n > 2 THEN 'many references' END, CASE WHEN sources > 1 THEN 'several sources' END, CASE WHEN labelled < n THEN 'uncited reference' END, CASE WHEN same.first <> item_id THEN 'repeated question' END], lambda x: x IS NOT NULL)) AS rule
FROM benchmark b LEFT JOIN refs ON qid = item_id JOIN same ON same.t = lower(trim(b.text))"""))
def question_set_rules(spark, sf):
    """Six rules of a question set, a row for each rule that a question breaks."""
    marked = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l"))
    joined = domain.gold(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").join(marked, "doc_id", "left")
    refs = joined.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.count("l").alias("labelled"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text", F.lower(F.trim("text")).alias("t"))
    first = asked.groupBy("t").agg(F.min("qid").alias("first"))
    rules = {"short": F.length("text") < 100, "no reference": F.col("n").isNull(), "many references": F.col("n") > 2, "several sources": F.col("sources") > 1, "uncited reference": F.col("labelled") < F.col("n"), "repeated question": F.col("first") != F.col("qid")}
    return asked.join(refs, "qid", "left").join(first, "t").select("qid", F.explode(F.array_compact(F.array(*[F.when(x, r) for r, x in rules.items()]))).alias("rule"))


@query("document_sequences", """
WITH s AS (SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: md5(trim(x))), ',')) AS sequence FROM documents)
SELECT sequence, count(*) AS documents, min(doc_id) AS first, max(doc_id) AS last FROM s GROUP BY sequence HAVING count(*) > 1""")
def document_sequences(spark, sf):
    """Documents whose lines have the same digests in the same order."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = _docs(spark, sf).select("doc_id", F.md5(F.array_join(F.transform(lines, lambda x: F.md5(x)), ",")).alias("sequence"))
    return rows.groupBy("sequence").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("documents > 1")


@query("boilerplate_ratio", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT line FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS lines, count(c.line) AS shared, floor(coalesce(sum(length(c.line)), 0)::DOUBLE / greatest(1, sum(length(l.line))) * 10000 + 0.5) / 10000 AS ratio FROM l LEFT JOIN c USING (line) GROUP BY doc_id""")
def boilerplate_ratio(spark, sf):
    """The share of a document's characters in lines that another document has too."""
    lines = _docs(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("h", F.xxhash64("line"))
    common = lines.where(F.length("line") >= 20).groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("h", F.lit(1).alias("c"))
    chars = F.length("line")
    ratio = F.sum(F.when(F.col("c") == 1, chars).otherwise(0)) / F.greatest(F.lit(1), F.sum(chars))
    return lines.select("doc_id", "h", "line").join(common, "h", "left").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("c").alias("shared"), T.half_up(ratio, 4).alias("ratio"))


@query("unswapped_verdicts", """
WITH s AS (SELECT item_id AS qid, list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c))) % 2 = 0 AS swapped, CASE item_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS said FROM benchmark)
SELECT qid, said, CASE WHEN said = 'tie' THEN 'tie' WHEN swapped THEN CASE said WHEN 'A' THEN 'B' ELSE 'A' END ELSE said END AS verdict FROM s""")
def unswapped_verdicts(spark, sf):
    """Verdicts over swapped sides turned back."""
    total = F.aggregate(F.split("text", ""), F.lit(0), lambda s, c: s + F.ascii(c))
    said = F.when(F.col("item_id") % 3 == 0, "A").when(F.col("item_id") % 3 == 1, "B").otherwise("tie")
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), (total % 2 == 0).alias("swapped"), said.alias("said"))
    back = F.when(F.col("said") == "tie", "tie").when(F.col("swapped"), F.when(F.col("said") == "A", "B").otherwise("A")).otherwise(F.col("said"))
    return rows.select("qid", "said", back.alias("verdict"))


_METRICS = """
WITH m AS (SELECT user_id AS level, event_type AS metric, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
latest AS (SELECT level, metric, arg_max(CASE WHEN value IS NULL THEN 'null' ELSE CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) AS VARCHAR) END, event_id) AS v FROM m GROUP BY ALL),
cents AS (SELECT level, metric, CASE WHEN v = 'null' THEN NULL ELSE CAST(v AS BIGINT) END AS cents FROM latest)"""


def _latest_metrics(spark, sf):
    """level, metric and cents: the last artefact of each, perhaps without a value."""
    value = F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") * 100 + 0.5))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("level"), F.col("event_type").alias("metric"), "event_id", value.alias("cents"))
    return rows.groupBy("level", "metric").agg(F.max_by(F.struct("cents"), "event_id").alias("s")).select("level", "metric", "s.cents")


@query("latest_metric_means", _METRICS + " SELECT metric, count(*) AS levels, count(cents) AS judged, floor(avg(cents) + 0.5) AS mean_cents FROM cents GROUP BY metric")
def latest_metric_means(spark, sf):
    """Means over sparse metrics, where the latest artefact of a level wins."""
    return _latest_metrics(spark, sf).groupBy("metric").agg(F.count("*").alias("levels"), F.count("cents").alias("judged"), F.floor(F.avg("cents") + 0.5).cast("double").alias("mean_cents"))


@query("metric_gaps", _METRICS + """, whole AS (SELECT metric, avg(cents) AS mean FROM cents GROUP BY metric)
SELECT level, metric, floor(mean + 0.5) AS filled_cents FROM cents JOIN whole USING (metric) WHERE cents IS NULL""")
def metric_gaps(spark, sf):
    """Metrics without a value, filled by the metric's mean."""
    rows = _latest_metrics(spark, sf)
    mean = rows.groupBy("metric").agg(F.floor(F.avg("cents") + 0.5).cast("double").alias("filled_cents"))
    return rows.where("cents is null").join(mean, "metric").select("level", "metric", "filled_cents")
