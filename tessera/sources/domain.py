"""The evidence-graph domain over the driver's tables: nodes, typed edges, profiles, chunks and questions.

``SQL`` has the same tables as DuckDB common table expressions, for the oracles; ``ctes`` puts the
needed ones in front of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import latin_tokens
from tessera.operators.checkpoints import kept
from tessera.operators.containment import contained
from tessera.operators.ordering import within
from tessera.sources.session import guarded

#: Characters that a line needs to be a chunk.
LEAST_CHUNK = 40
#: Rows of lineitem, of which each is an edge at most, that one task takes on.
ROWS_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return guarded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, dealt out where the files give fewer tasks than there are cores.

    A large table has far more file splits than cores and is read as it lies, without a shuffle.
    """
    rows = table(spark, sf_dir, "documents").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind and label of occupations, skills, domains and tools."""
    part = table(spark, sf_dir, "part")

    def of(df, kind, key, label):
        return df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))

    return (
        of(table(spark, sf_dir, "supplier"), "occupation", "s_suppkey", "s_name")
        .union(of(part, "skill", "p_partkey", "p_name"))
        .union(of(part.select("p_brand").distinct(), "domain", "p_brand", "p_brand"))
        .union(of(part.select("p_type").distinct(), "tool", "p_type", "p_type"))
    )


def edge_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the edges are dealt out to: a core each at least, and as many more as the rows ask for."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // ROWS_A_TASK))


def requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occupation, skill, importance (0 to 1 within the occupation) and target_level (1 to 5)."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("occupation"), F.col("l_partkey").alias("skill"), "l_quantity")
    # Hardly any pair comes twice in the rows of a reader, which would hold nearly all of them to add up.
    dealt = items.repartition(edge_tasks(spark, sf_dir), "occupation", "skill")
    per = dealt.groupBy("occupation", "skill").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    top = F.max("qty").over(Window.partitionBy("occupation"))
    return per.select("occupation", "skill", (F.col("qty") / top).alias("importance"), F.least(F.lit(5), F.col("n")).cast("int").alias("target_level"))


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src and dst skills of one brand in neighbouring tiers: at most two parents, depth at most 4."""
    tier = F.ceil(F.col("p_size") / 10).cast("int")
    # Places in (brand, tier) without one task for each, of which there are few.
    ranked = within(table(spark, sf_dir, "part").select("p_partkey", "p_brand", tier.alias("tier")).withColumn("_cell", F.struct("p_brand", "tier")), "_cell", "p_partkey", "rn")
    ranked = ranked.select("p_partkey", "p_brand", "tier", "rn")
    src = ranked.select(F.col("p_partkey").alias("src"), "p_brand", (F.col("tier") + 1).alias("tier"), F.explode(F.array(F.col("rn"), F.col("rn") + 1)).alias("rn"))
    return src.join(ranked.withColumnRenamed("p_partkey", "dst"), ["p_brand", "tier", "rn"]).select("src", "dst")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src and dst: consecutive suppliers of a nation."""
    placed = within(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey")
    following = placed.select("s_nationkey", F.col("s_suppkey").alias("dst"), (F.col("at") - 1).alias("at"))
    return placed.join(following, ["s_nationkey", "at"]).select(F.col("s_suppkey").alias("src"), "dst")


def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, aliases and description of each node: a skill is also known by its noun and described by its kind."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("skill:"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.element_at(F.split("p_name", " "), -1)).alias("aliases"), F.col("p_type").alias("description"))
    rows = nodes(spark, sf_dir).join(part, "id", "left")
    return rows.select("id", "label", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("description", F.lit("")).alias("description"))


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, src and dst (node ids) of all edges; ``evidenced_by`` ends at a document, not at a node."""
    part, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")

    def of(df, kind, src, dst, a, b):
        ends = [F.concat(F.lit(f"{k}:"), F.col(c).cast("string")).alias(n) for k, c, n in ((src, a, "src"), (dst, b, "dst"))]
        return df.select(F.lit(kind).alias("type"), *ends)

    return (
        of(requires(spark, sf_dir), "requires", "occupation", "skill", "occupation", "skill")
        .union(of(prerequisites(spark, sf_dir), "prerequisite", "skill", "skill", "src", "dst"))
        .union(of(transitions(spark, sf_dir), "transitions_to", "occupation", "occupation", "src", "dst"))
        .union(of(part, "belongs_to", "skill", "domain", "p_partkey", "p_brand"))
        .union(of(part, "uses", "skill", "tool", "p_partkey", "p_type"))
        .union(of(part.join(docs, F.col("p_partkey") == F.col("doc_id")), "evidenced_by", "skill", "chunk", "p_partkey", "doc_id"))
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile and occupation: each profile asks for the occupation that it has had most to do with, ties to the smaller."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("profile"))
    met = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("occupation")).join(orders, "l_orderkey")
    counts = met.groupBy("profile", "occupation").agg(F.count("*").alias("n"))
    return counts.groupBy("profile").agg(F.min_by("occupation", F.struct((-F.col("n")).alias("n"), "occupation")).alias("occupation"))


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile and skill: the distinct parts of a customer's orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("profile"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("skill"))
    return items.join(orders, "l_orderkey").select("profile", "skill").distinct()


def chunks(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, source, lang, pos, start, end and text of each line of at least ``LEAST_CHUNK`` characters.

    ``wanted`` has the doc_id of the documents to take, which goes to every task; all are taken if it is not given. Lines are
    placed where their text lies, so no text moves.
    """
    rows = documents(spark, sf_dir, "doc_id", "source", "lang", "text")
    if wanted is not None:
        rows = rows.join(F.broadcast(wanted.select("doc_id").distinct()), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, start, end, lines = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                at = 0
                for n, line in enumerate(text.split("\n") if text is not None else ()):
                    if len(line) >= LEAST_CHUNK:
                        row.append(i)
                        pos.append(n)
                        start.append(at)
                        end.append(at + len(line))
                        lines.append(line)
                    at += len(line) + 1
            own = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(lines, pa.string())], ["doc_id", "source", "lang", "pos", "start", "end", "text"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("doc_id", "source", "lang")) + ", pos int, start long, end long, text string")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, term (repeated terms stay) and at of each question's terms."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), latin_tokens("text").alias("terms"))
    return items.select("qid", F.posexplode("terms").alias("at", "term"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, doc_id: documents that contain a benchmark item's text."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.col("text").alias("passage"))

    def make() -> DataFrame:
        return contained(documents(spark, sf_dir, "doc_id", "text"), items).select(F.col("item").alias("qid"), "doc_id")

    return kept(spark, "gold", [f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet"], make)


# The same tables for DuckDB.
SQL = {
    "nodes": """nodes AS (
  SELECT 'occupation:' || s_suppkey AS id, 'occupation' AS kind, s_name AS label FROM supplier
  UNION ALL SELECT 'skill:' || p_partkey, 'skill', p_name FROM part
  UNION ALL SELECT DISTINCT 'domain:' || p_brand, 'domain', p_brand FROM part
  UNION ALL SELECT DISTINCT 'tool:' || p_type, 'tool', p_type FROM part)""",
    "requires": """requires AS (
  SELECT occupation, skill, qty / max(qty) OVER (PARTITION BY occupation) AS importance, CAST(least(5, n) AS INTEGER) AS target_level
  FROM (SELECT l_suppkey AS occupation, l_partkey AS skill, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ALL))""",
    "prerequisites": """tiers AS (
  SELECT p_partkey, p_brand, CAST(ceil(p_size / 10.0) AS INTEGER) AS tier FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand, tier ORDER BY p_partkey) AS rn FROM tiers),
prerequisites AS (
  SELECT a.p_partkey AS src, b.p_partkey AS dst FROM ranked a JOIN ranked b
  ON a.p_brand = b.p_brand AND b.tier = a.tier + 1 AND b.rn IN (a.rn, a.rn + 1))""",
    "transitions": """transitions AS (
  SELECT * FROM (SELECT s_suppkey AS src, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dst FROM supplier)
  WHERE dst IS NOT NULL)""",
    "node_texts": """node_texts AS (
  SELECT id, label, CASE WHEN kind = 'skill' THEN [string_split(label, ' ')[-1]] ELSE [] END AS aliases, coalesce(p_type, '') AS description FROM nodes LEFT JOIN part ON id = 'skill:' || p_partkey)""",
    "typed_edges": """typed_edges AS (
  SELECT 'requires' AS type, 'occupation:' || occupation AS src, 'skill:' || skill AS dst FROM requires
  UNION ALL SELECT 'prerequisite', 'skill:' || src, 'skill:' || dst FROM prerequisites
  UNION ALL SELECT 'transitions_to', 'occupation:' || src, 'occupation:' || dst FROM transitions
  UNION ALL SELECT 'belongs_to', 'skill:' || p_partkey, 'domain:' || p_brand FROM part
  UNION ALL SELECT 'uses', 'skill:' || p_partkey, 'tool:' || p_type FROM part
  UNION ALL SELECT 'evidenced_by', 'skill:' || p_partkey, 'chunk:' || doc_id FROM part JOIN documents ON doc_id = p_partkey),
adjacency AS (
  SELECT src, dst FROM typed_edges WHERE dst NOT LIKE 'chunk:%' UNION SELECT dst, src FROM typed_edges WHERE dst NOT LIKE 'chunk:%')""",
    "targets": """target AS (
  SELECT profile, arg_min(occupation, (-n, occupation)) AS occupation FROM (SELECT o_custkey AS profile, l_suppkey AS occupation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY profile)""",
    "owned": """owned AS (
  SELECT DISTINCT o_custkey AS profile, l_partkey AS skill FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "chunks": """lines AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
placed AS (
  SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines),
chunks AS (SELECT doc_id, source, lang, pos, start, start + length(text) AS "end", text FROM placed WHERE length(text) >= 40)""",
    "questions": """terms AS (
  SELECT item_id AS qid, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*') AS t FROM benchmark),
questions AS (SELECT qid, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS at FROM terms)""",
    "gold": """gold AS (
  SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))""",
    "postings": """tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*')) AS term FROM documents),
postings AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*')) AS size FROM documents),
stats AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
frequencies AS (SELECT term, count(*) AS df FROM postings GROUP BY term)""",
    "bm25": """scored AS (
  SELECT q.qid, p.doc_id, floor(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
         / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean))) * 1000 + 0.5) / 1000 AS score
  FROM questions q JOIN postings p USING (term) JOIN frequencies USING (term) JOIN sizes USING (doc_id) CROSS JOIN stats GROUP BY ALL),
bm25 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 50)""",
    "dense": """pairs AS (
  SELECT q.vec_id AS qid, d.vec_id AS doc_id, floor(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) * 1000000 + 0.5) / 1000000 AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM pairs) WHERE rank <= 50)""",
}


def ctes(*names: str, body: str) -> str:
    """A DuckDB query: the named tables, then ``body`` (which may begin with further ones)."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + body
