"""Further queries: cascades, sweeps, ablations, judging and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fields, retrieval, segment, text_index
from tessera.operators.checkpoints import folder, settled
from tessera.operators.commits import Store
from tessera.plans.registry import query
from tessera.plans.retrieval import _BOTH, _CHANNELS, _bm25, _dense, _outcomes, _OUTCOMES
from tessera.sources import domain
from tessera.sources.domain import ctes, table


@query("eligible_documents", "SELECT doc_id FROM documents d WHERE length(text) >= 200 AND regexp_matches(text, '[A-Za-z]') AND doc_id NOT IN (SELECT doc_id FROM labels) AND source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 10)")
def eligible_documents(spark, sf):
    """Long enough, readable, not cited, of a listed source."""
    docs = table(spark, sf, "documents")
    listed = docs.groupBy("source").count().where("count > 10").select("source")
    good = docs.where((F.length("text") >= 200) & F.col("text").rlike("[A-Za-z]")).select("doc_id", "source")
    return good.join(table(spark, sf, "labels"), "doc_id", "left_anti").join(listed, "source", "left_semi").select("doc_id")


@query("citations_with_defaults", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def citations_with_defaults(spark, sf):
    """A left join with defaults."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("resolve_references", """
WITH refs AS (SELECT unnest(['Supplier#000000001', 'SUPPLIER#000000002', '3', 'supplier', 'nothing such']) AS ref),
m AS (
  SELECT ref, s_suppkey AS id, 1 AS p FROM refs JOIN supplier ON CAST(s_suppkey AS VARCHAR) = ref
  UNION ALL SELECT ref, s_suppkey, 2 FROM refs JOIN supplier ON s_name = ref
  UNION ALL SELECT ref, s_suppkey, 3 FROM refs JOIN supplier ON lower(s_name) = lower(ref)),
b AS (SELECT ref, min(p) AS p FROM m GROUP BY ref)
SELECT ref, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id, min(p) AS step FROM refs LEFT JOIN b USING (ref) LEFT JOIN m USING (ref, p) GROUP BY ref""")
def resolve_references(spark, sf):
    """Id, then label, then label in any case; several at the first step that finds any give null."""
    refs = spark.createDataFrame([(r,) for r in ("Supplier#000000001", "SUPPLIER#000000002", "3", "supplier", "nothing such")], "ref string")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    steps = [(F.col("s_suppkey").cast("string"), F.col("ref")), (F.col("s_name"), F.col("ref")), (F.lower("s_name"), F.lower("ref"))]
    found = reduce(lambda a, b: a.union(b), [refs.join(s, left == right).select("ref", F.col("s_suppkey").alias("id"), F.lit(p).alias("p")) for p, (left, right) in enumerate(steps, 1)])
    first = found.groupBy("ref").agg(F.min("p").alias("p"))
    best = found.join(first, ["ref", "p"]).groupBy("ref").agg(F.when(F.countDistinct("id") == 1, F.min("id")).alias("id"), F.min("p").alias("step"))
    return refs.join(best, "ref", "left")


@query("pair_capacity", "SELECT source, count(*) AS documents, CAST(count(*) // 2 AS BIGINT) AS pairs FROM documents GROUP BY source")
def pair_capacity(spark, sf):
    """Pairs that a source can give."""
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.floor(F.count("*") / 2).alias("pairs"))


#: Splits of the questions into halves: as many as fourteen questions have.
SPLITS = 3432


@query("split_half", ctes(*_CHANNELS, "gold", body=_OUTCOMES + """,
own AS (SELECT qid, CAST(hits1 > 0 AS INTEGER) AS a, CAST(hits3 > 0 AS INTEGER) AS b, count(*) OVER () AS n FROM outcomes),
splits AS (SELECT unnest(range(0, 3432)) AS split),
dealt AS (SELECT split, a, b, n // 2 AS half, n, row_number() OVER (PARTITION BY split ORDER BY md5(split || ':' || qid), qid) <= n // 2 AS inside FROM own, splits),
h AS (SELECT split, half, n - half AS rest, sum(a) FILTER (inside) AS a_in, sum(b) FILTER (inside) AS b_in, sum(a) AS a_all, sum(b) AS b_all FROM dealt GROUP BY ALL)
SELECT count(*) AS splits, count(*) FILTER (b_in > a_in) AS chosen, floor(avg(greatest(a_in, b_in) / half::DOUBLE - CASE WHEN b_in > a_in THEN b_all - b_in ELSE a_all - a_in END / rest::DOUBLE) * 10000 + 0.5) / 10000 AS optimism FROM h"""))
def split_half(spark, sf):
    """Optimism of choosing a measure by one half of the questions, over seeded splits of all of them."""
    # A row for each question; settled, as the search would run again for their number.
    own = settled(_outcomes(spark, sf).select("qid", (F.col("hits1") > 0).cast("int").alias("a"), (F.col("hits3") > 0).cast("int").alias("b")))
    n = own.count()
    half = n // 2
    dealt = own.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    place = F.row_number().over(Window.partitionBy("split").orderBy(F.md5(F.concat_ws(":", F.col("split").cast("string"), F.col("qid").cast("string"))), "qid"))
    dealt = dealt.withColumn("inside", place <= half)
    h = dealt.groupBy("split").agg(F.sum(F.when(F.col("inside"), F.col("a"))).alias("a_in"), F.sum(F.when(F.col("inside"), F.col("b"))).alias("b_in"), F.sum("a").alias("a_all"), F.sum("b").alias("b_all"))
    rest = F.when(F.col("b_in") > F.col("a_in"), F.col("b_all") - F.col("b_in")).otherwise(F.col("a_all") - F.col("a_in"))
    optimism = F.avg(F.greatest("a_in", "b_in") / F.lit(half) - rest / F.lit(n - half))
    return h.agg(F.count("*").alias("splits"), F.count_if(F.col("b_in") > F.col("a_in")).alias("chosen"), T.half_up(optimism, 4).alias("optimism"))


@query("keyword_hit_rate", ctes("questions", body="""
, t AS (SELECT DISTINCT qid, term FROM questions),
n AS (SELECT qid, count(*) AS terms FROM t GROUP BY qid),
h AS (SELECT DISTINCT t.qid FROM t JOIN n USING (qid) JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*')) AS term FROM documents) d USING (term) GROUP BY t.qid, d.doc_id, n.terms HAVING count(*) = n.terms)
SELECT count(*) AS questions, count(h.qid) AS answered FROM n LEFT JOIN h USING (qid)"""))
def keyword_hit_rate(spark, sf):
    """Questions whose terms all stand in one document."""
    index = text_index.index_of(spark, f"{sf}/documents.parquet", domain.documents(spark, sf, "doc_id", "text"))
    t = domain.questions(spark, sf).select("qid", "term").distinct()
    n = t.groupBy("qid").agg(F.count("*").alias("terms"))
    full = text_index.answered(index, t).select("qid").distinct().withColumn("hit", F.lit(1))
    return n.join(full, "qid", "left").agg(F.count("*").alias("questions"), F.count("hit").alias("answered"))


@query("layer_oracle", ctes(*_BOTH, "gold", body="""
, o AS (SELECT g.qid, g.qid % 2 AS layer, max(CAST(coalesce(b.rank, 99) <= 3 AS INTEGER)) AS x, max(CAST(coalesce(d.rank, 99) <= 3 AS INTEGER)) AS y FROM gold g LEFT JOIN bm25 b USING (qid, doc_id) LEFT JOIN dense d USING (qid, doc_id) GROUP BY g.qid)
SELECT layer, CAST(sum(x) AS BIGINT) AS lexical, CAST(sum(y) AS BIGINT) AS dense, CAST(greatest(sum(x), sum(y)) AS BIGINT) AS best FROM o GROUP BY layer"""))
def layer_oracle(spark, sf):
    """The better channel of each layer, an upper bound."""
    gold = domain.gold(spark, sf)
    lexical = _bm25(spark, sf).where("rank <= 3").select("qid", "doc_id", F.lit(1).alias("x"))
    dense = _dense(spark, sf).where("rank <= 3").select("qid", "doc_id", F.lit(1).alias("y"))
    o = gold.join(lexical, ["qid", "doc_id"], "left").join(dense, ["qid", "doc_id"], "left").groupBy("qid").agg(F.max(F.coalesce("x", F.lit(0))).alias("x"), F.max(F.coalesce("y", F.lit(0))).alias("y"))
    return o.groupBy((F.col("qid") % 2).alias("layer")).agg(F.sum("x").alias("lexical"), F.sum("y").alias("dense")).withColumn("best", F.greatest("lexical", "dense"))


@query("source_boost", ctes(*_CHANNELS, body="""
, s AS (SELECT qid, doc_id, floor(b.score * (CASE WHEN l.quality = 1 THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN d.lang = 'en' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END) * 1000000 + 0.5) / 1000000 AS score
  FROM bm25 b JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""))
def source_boost(spark, sf):
    """Multiplicative boosts, ranked again."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    joined = _bm25(spark, sf).drop("rank").join(docs, "doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    factor = F.when(F.col("quality") == 1, 1.3).otherwise(1.0) * F.when(F.col("lang") == "en", 1.15).otherwise(1.0)
    return retrieval.top(joined.select("qid", "doc_id", T.half_up(F.col("score") * factor, 6).alias("score")), 10)


@query("section_channel", ctes(*_CHANNELS, body="""
, first AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9][a-z0-9+._#-]*')) AS t FROM documents),
s AS (SELECT b.qid, b.doc_id, floor((b.score + 2.0::DOUBLE * count(q.term)) * 1000000 + 0.5) / 1000000 AS score
  FROM bm25 b JOIN first f USING (doc_id) LEFT JOIN (SELECT DISTINCT qid, term FROM questions) q ON q.qid = b.qid AND list_contains(f.t, q.term) GROUP BY b.qid, b.doc_id, b.score)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""))
def section_channel(spark, sf):
    """Terms of a document's first line count on top."""
    first = table(spark, sf, "documents").select("doc_id", F.array_distinct(T.latin_tokens(F.element_at(F.split("text", "\n"), 1))).alias("t"))
    asked = domain.questions(spark, sf).groupBy("qid").agg(F.collect_set("term").alias("q"))
    joined = _bm25(spark, sf).drop("rank").join(first, "doc_id").join(asked, "qid")
    return retrieval.top(joined.select("qid", "doc_id", T.half_up(F.col("score") + 2.0 * F.size(F.array_intersect("t", "q")), 6).alias("score")), 10)


@query("term_map_expansion", ctes("questions", body="""
, map_ AS (SELECT lower(p_brand) AS term, min(lower(p_type)) AS added FROM part GROUP BY 1 UNION ALL SELECT 'the', 'article' UNION ALL SELECT 'of', 'preposition')
SELECT qid, string_agg(DISTINCT added, ' ' ORDER BY added) AS added FROM questions JOIN map_ USING (term) GROUP BY qid"""))
def term_map_expansion(spark, sf):
    """Words that a map adds to a question."""
    known = table(spark, sf, "part").groupBy(F.lower("p_brand").alias("term")).agg(F.min(F.lower("p_type")).alias("added"))
    known = known.union(spark.createDataFrame([("the", "article"), ("of", "preposition")], "term string, added string"))
    return domain.questions(spark, sf).join(known, "term").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("added")), " ").alias("added"))


@query("expanded_query", ctes("questions", "postings", "bm25", body="""
, added AS (SELECT b.qid, 'src' || right(d.source, 1) AS term FROM bm25 b JOIN documents d USING (doc_id) WHERE rank <= 2),
more AS (SELECT qid, term FROM questions UNION ALL SELECT qid, term FROM added)
SELECT qid, count(*) AS terms, count(DISTINCT term) AS distinct_terms FROM more GROUP BY qid"""))
def expanded_query(spark, sf):
    """A question's terms with those of the neighbours of its best hits."""
    sources = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("src"), F.right("source", F.lit(1))).alias("term"))
    added = _bm25(spark, sf, 2).join(sources, "doc_id").select("qid", "term")
    return domain.questions(spark, sf).select("qid", "term").union(added).groupBy("qid").agg(F.count("*").alias("terms"), F.countDistinct("term").alias("distinct_terms"))


@query("parent_children", ctes(*_CHANNELS, body="""
, p AS (SELECT qid, doc_id // 10 AS doc_id, max(score) AS score, count(*) AS children FROM bm25 GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM p) WHERE rank <= 3"""))
def parent_children(spark, sf):
    """Parents by their best child."""
    parents = _bm25(spark, sf).groupBy("qid", F.floor(F.col("doc_id") / 10).alias("doc_id")).agg(F.max("score").alias("score"), F.count("*").alias("children"))
    return retrieval.top(parents, 3)


@query("ablation", ctes(*_BOTH, "gold", body="""
, runs AS (SELECT 'lexical' AS config, qid, doc_id, rank FROM bm25 UNION ALL SELECT 'dense', qid, doc_id, rank FROM dense UNION ALL SELECT 'top1', qid, doc_id, rank FROM bm25 WHERE rank = 1)
SELECT config, count(*) AS rows_, count(DISTINCT qid) AS questions, (SELECT count(*) FROM gold g WHERE EXISTS (FROM runs r2 WHERE r2.config = r.config AND r2.qid = g.qid AND r2.doc_id = g.doc_id AND r2.rank <= 3)) AS hits FROM runs r GROUP BY config"""))
def ablation(spark, sf):
    """The same questions under several configurations."""
    lexical, dense = _bm25(spark, sf), _dense(spark, sf)
    runs = lexical.withColumn("config", F.lit("lexical")).unionByName(dense.withColumn("config", F.lit("dense"))).unionByName(lexical.where("rank = 1").withColumn("config", F.lit("top1")))
    gold = domain.gold(spark, sf).withColumn("gold", F.lit(1))
    return runs.join(gold, ["qid", "doc_id"], "left").groupBy("config").agg(F.count("*").alias("rows_"), F.countDistinct("qid").alias("questions"), F.count_if((F.col("gold") == 1) & (F.col("rank") <= 3)).alias("hits"))


@query("citation_support", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS INTEGER) AS refs, contains(text, 'License') AND contains(text, 'Released') AS supported FROM documents")
def citation_support(spark, sf):
    """References found by a pattern, and whether all anchors are there."""
    anchors = F.forall(F.array(F.lit("License"), F.lit("Released")), lambda a: F.contains("text", a))
    return table(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("refs"), anchors.alias("supported"))


@query("chunk_sweep", """
WITH sizes AS (SELECT unnest([200, 400, 800]) AS size)
SELECT size, CAST(sum(ceil(length(text) / size::DOUBLE)) AS BIGINT) AS chunks, count(*) FILTER (length(text) <= size) AS whole FROM documents, sizes GROUP BY size""")
def chunk_sweep(spark, sf):
    """Chunks of each size, and documents that fit into one."""
    sized = table(spark, sf, "documents").select(F.length("text").alias("n"), F.explode(F.array(*map(F.lit, (200, 400, 800)))).alias("size"))
    return sized.groupBy("size").agg(F.sum(F.ceil(F.col("n") / F.col("size"))).alias("chunks"), F.count_if(F.col("n") <= F.col("size")).alias("whole"))


@query("sparse_means", "SELECT source, count(l.quality) AS judged, floor(avg(l.quality) * 10000 + 0.5) / 10000 AS mean FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source")
def sparse_means(spark, sf):
    """Means over the rows that have a value, and how many have."""
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("quality").alias("judged"), T.half_up(F.avg("quality"), 4).alias("mean"))


@query("order_swap", "SELECT item_id AS qid, list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c))) % 2 = 0 AS swapped FROM benchmark")
def order_swap(spark, sf):
    """Sides are swapped by the parity of the code points' sum."""
    chars = F.split("text", "")
    total = F.aggregate(chars, F.lit(0), lambda s, c: s + F.ascii(c))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), (total % 2 == 0).alias("swapped"))


@query("import_completeness", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS without_document")
def import_completeness(spark, sf):
    """Records without a vector, and vectors without a record."""
    ids = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("d"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v"))
    both = ids.join(vectors, "doc_id", "full")
    return both.agg(F.count_if(F.col("v").isNull()).alias("without_vector"), F.count_if(F.col("d").isNull()).alias("without_document"))


@query("hash_verification", "SELECT doc_id, sha256(text) AS stored, sha256(replace(text, chr(10), chr(13) || chr(10))) AS crlf, contains(text, chr(10)) AS lines FROM documents")
def hash_verification(spark, sf):
    """Digests under both kinds of line ends."""
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("stored"), F.sha2(F.replace("text", F.lit("\n"), F.lit("\r\n")), 256).alias("crlf"), F.contains("text", F.lit("\n")).alias("lines"))


@query("term_inventory", "SELECT term, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT source, unnest(regexp_extract_all(string_split(text, chr(10))[1], '[A-Z][a-z]{5,}')) AS term FROM documents) GROUP BY term")
def term_inventory(spark, sf):
    """Names in first lines with the sources that have them."""
    head = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all(F.element_at(F.split("text", "\n"), 1), F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("term"))
    return head.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("segmented_words")
def segmented_words(spark, sf):
    """Texts cut into the syllables and words of the questions, as scripts without blanks are: best path through a dictionary."""
    asked = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,4}"), F.lit(0))).alias("word"))
    found = segment.segmented(domain.documents(spark, sf, "doc_id", "text"), asked.groupBy("word").agg(F.count("*").alias("n")), "[a-z]+")
    return found.select("doc_id", F.size("tokens").alias("pieces"), F.md5(F.concat_ws(" ", "tokens")).alias("tokens_md5"))


#: What is read from a profile's text.
FIELDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]+",
    "phone": r"\+[0-9]+ \([0-9]+\) [0-9]+-[0-9]+",
    "address": r"[0-9]{1,3}(\.[0-9]{1,3}){3}",
    "year": r"(19|20)[0-9]{2}",
    "licence": r"(MIT|Apache|GNU)[A-Za-z ]{0,30}License",
    "name": r"[A-Z][a-z]{3,} [A-Z][a-z]{3,}",
    "heading": r"[A-Z][a-z]+( [a-z]+){0,5}\.",
    "number": r"[0-9]{4,}",
}
_FIELDS = " UNION ALL ".join(f"SELECT doc_id, text, '{name}' AS field, regexp_extract(text, '{pattern}', 0) AS value FROM documents" for name, pattern in FIELDS.items())


@query("resume_fields", f"SELECT doc_id, field, value, CAST(strpos(text, value) - 1 AS BIGINT) AS start, CAST(strpos(text, value) - 1 + length(value) AS BIGINT) AS \"end\" FROM ({_FIELDS}) WHERE value <> ''")
def resume_fields(spark, sf):
    """Eight fields of a text, each with the place that proves it."""
    return fields.extracted(domain.documents(spark, sf, "doc_id", "text"), FIELDS)


#: Titles of sections, in lower case.
TITLES = {"licence": ["this work is licensed under the gnu general public license"], "remark": ["the", "la", "el"], "note": ["in", "en"]}
_TITLE = " ".join(f"WHEN {' OR '.join(f'(starts_with(plain, {chr(39)}{t}{chr(39)}) AND length(plain) <= {len(t) + fields.MORE})' for t in own)} THEN '{name}'" for name, own in TITLES.items())


@query("resume_sections", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at_ FROM documents),
p AS (SELECT *, trim(regexp_replace(translate(lower(regexp_replace(line, '[:：].*$', '')), '（）【】　，。：；！？', '()[] ,.:;!?'), '\s+', ' ', 'g')) AS plain FROM l),
t AS (SELECT *, CASE """ + _TITLE + r""" END AS title FROM p),
s AS (SELECT *, coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY at_ ROWS UNBOUNDED PRECEDING), 'header') AS section, CASE WHEN title IS NULL THEN line ELSE nullif(trim(regexp_extract(line, '[:：](.*)$', 1)), '') END AS kept FROM t)
SELECT doc_id, section, count(kept) AS lines, md5(coalesce(string_agg(kept, chr(10) ORDER BY at_), '')) AS text_md5 FROM s GROUP BY ALL""")
def resume_sections(spark, sf):
    """Sections of a text by their titles."""
    found = fields.sections(domain.documents(spark, sf, "doc_id", "text"), TITLES)
    return found.select("doc_id", "section", "lines", F.md5("text").alias("text_md5"))


@query("rule_scores", r"SELECT conv_id, turn, CAST(least(40, length(text) // 20) + CASE WHEN contains(text, chr(10)) THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 10 ELSE 0 END AS INTEGER) AS score FROM conversations WHERE role = 'assistant'")
def rule_scores(spark, sf):
    """Points for length, structure and figures."""
    score = F.least(F.lit(40), F.floor(F.length("text") / 20)) + F.when(F.contains("text", F.lit("\n")), 20).otherwise(0) + F.when(F.col("text").rlike("[0-9]"), 10).otherwise(0)
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", score.cast("int").alias("score"))


@query("gated_merge", "SELECT a.conv_id, a.turn, contains(u.text, substr(a.text, 1, 4)) AS accepted FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant'")
def gated_merge(spark, sf):
    """A quote is accepted where the source text has it."""
    said = table(spark, sf, "conversations")
    before = said.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return said.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.contains("source", F.substring("text", 1, 4)).alias("accepted"))


@query("evidence_edges", ctes("gold", body=" SELECT 'doc:' || doc_id AS src, 'item:' || qid AS dst, 'evidenced_by' AS type FROM gold"))
def evidence_edges(spark, sf):
    """Edges that follow from citations."""
    return domain.gold(spark, sf).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("item:"), F.col("qid").cast("string")).alias("dst"), F.lit("evidenced_by").alias("type"))


@query("confirmed_events", "SELECT o_custkey, o_orderkey, 'evidence' AS ledger FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 'event' FROM orders WHERE o_orderstatus = 'F'")
def confirmed_events(spark, sf):
    """A confirmation writes to two ledgers, which one commit publishes, and both are read back."""
    store = Store(spark, f"{folder(spark)}/confirmations-{spark.sparkContext.applicationId}")
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    version = store.commit(replaced={"evidence": done, "event": done})
    store.vacuum(keep=2)
    ledgers = [store.read(name, version).withColumn("ledger", F.lit(name)) for name in ("evidence", "event")]
    return ledgers[0].unionByName(ledgers[1])


@query("alias_decisions", "SELECT lower(p_name) AS key, count(*) AS ids, CASE WHEN count(*) = 1 THEN 'unique' WHEN min(p_partkey) % 2 = 0 THEN 'decided' ELSE 'open' END AS status FROM part GROUP BY 1")
def alias_decisions(spark, sf):
    """Ambiguous aliases with and without a decision."""
    per = table(spark, sf, "part").groupBy(F.lower("p_name").alias("key")).agg(F.count("*").alias("ids"), F.min("p_partkey").alias("first"))
    return per.select("key", "ids", F.when(F.col("ids") == 1, "unique").when(F.col("first") % 2 == 0, "decided").otherwise("open").alias("status"))
