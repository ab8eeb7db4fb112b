"""Queries of the retrieval and evaluation lab."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import cosine, half_up, latin_tokens, tokens
from tessera.operators import metrics, retrieval, text_index
from tessera.operators.checkpoints import settled
from tessera.operators.commits import Store
from tessera.operators.ordering import within
from tessera.plans.registry import query
from tessera.sources import domain
from tessera.sources.domain import ctes, table

DEPTH = 50


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return domain.documents(spark, sf, "doc_id", "text")


def _index(spark: SparkSession, sf: str) -> Store:
    """The session's index of the documents."""
    return text_index.index_of(spark, f"{sf}/documents.parquet", _docs(spark, sf))


def _ranked(spark: SparkSession, sf: str, terms: DataFrame, k: int) -> DataFrame:
    """The k best documents of each question of ``terms`` (qid, term) by the index."""
    return text_index.search(_index(spark, sf), retrieval.asked_of(terms), k)


def _bm25(spark: SparkSession, sf: str, k: int = DEPTH) -> DataFrame:
    return _ranked(spark, sf, domain.questions(spark, sf), k)


def _dense(spark: SparkSession, sf: str, k: int = DEPTH) -> DataFrame:
    """Question i asks with vector i; vectors stand for documents of their id."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"))
    asked = rows.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), "embedding")
    return retrieval.dense(asked, rows.withColumnRenamed("vec_id", "doc_id"), k)


_BOTH = ("questions", "postings", "bm25", "dense")
_CHANNELS = ("questions", "postings", "bm25")


@query("bm25_topk", ctes(*_CHANNELS, body=" SELECT qid, doc_id, score, rank FROM bm25 WHERE rank <= 3"))
def bm25_topk(spark, sf):
    """The three best documents of each question."""
    return _bm25(spark, sf, 3)


@query("bm25_corpus_stats", ctes("postings", body=" SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(size) AS BIGINT) AS tokens, floor(avg(size) * 10000 + 0.5) / 10000 AS mean FROM sizes"))
def bm25_corpus_stats(spark, sf):
    """A5: documents, tokens and mean size."""
    return retrieval.corpus_stats(_docs(spark, sf)).withColumn("mean", half_up("mean", 4))


#: Document ids in one row of a posting list.
POSTING_RANGE = 4096


@query("bm25_postings", ctes("postings", body="""
SELECT term, doc_id // 4096 AS part, df, count(*) AS documents, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM postings JOIN frequencies USING (term) GROUP BY ALL"""))
def bm25_postings(spark, sf):
    """R2: serialised postings of all terms, a row for each range of documents, so no list is unbounded."""
    store = _index(spark, sf)
    own, df = text_index.postings(store), text_index.frequencies(store)
    lists = own.groupBy("term", F.floor(F.col("doc_id") / POSTING_RANGE).alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p")).join(df, "term")
    return lists.select("term", "part", "df", F.size("p").cast("long").alias("documents"), F.array_join(F.transform("p", lambda x: F.concat_ws(":", x.doc_id.cast("string"), x.tf.cast("string"))), " ").alias("postings"))


@query("term_frequency", ctes("postings", body=" SELECT term, CAST(df AS BIGINT) AS df, (SELECT CAST(sum(tf) AS BIGINT) FROM postings p WHERE p.term = f.term) AS total FROM frequencies f"))
def term_frequency(spark, sf):
    """A3, A4: how often each term occurs, and in how many documents."""
    return text_index.occurrences(_index(spark, sf))


@query("dense_topk", ctes("dense", body=" SELECT qid, doc_id, score, rank FROM dense WHERE rank <= 10"))
def dense_topk(spark, sf):
    """Exact dense search."""
    return _dense(spark, sf, 10)


_SCALED = """,
a AS (SELECT qid, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM bm25 WINDOW w AS (PARTITION BY qid)),
b AS (SELECT qid, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS y FROM dense WINDOW w AS (PARTITION BY qid)),
fused AS (SELECT qid, doc_id, floor((0.35::DOUBLE * coalesce(x, 0.0) + (1 - 0.35::DOUBLE) * coalesce(y, 0.0)) * 1000000 + 0.5) / 1000000 AS score FROM a FULL JOIN b USING (qid, doc_id)),
minmaxed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 10)"""


def _fused(spark, sf, lexical=None, dense=None):
    return retrieval.fuse_scores(lexical or _bm25(spark, sf), dense or _dense(spark, sf), 0.35, 10)


@query("fusion_minmax", ctes(*_BOTH, body=_SCALED + " SELECT qid, doc_id, score, rank FROM minmaxed"))
def fusion_minmax(spark, sf):
    """Min-max scores of two channels, alpha 0.35."""
    return _fused(spark, sf)


@query(
    "fusion_rrf",
    ctes(*_BOTH, body=""",
s AS (SELECT qid, doc_id, floor(sum(v) * 1000000000 + 0.5) / 1000000000 AS score FROM (
  SELECT qid, doc_id, 0.2::DOUBLE / (60 + rank) AS v FROM bm25 UNION ALL SELECT qid, doc_id, 0.8::DOUBLE / (60 + rank) FROM dense) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""),
)
def fusion_rrf(spark, sf):
    """Weighted reciprocal ranks."""
    return retrieval.fuse_ranks([(_bm25(spark, sf), 0.2), (_dense(spark, sf), 0.8)], 60, 10)


@query(
    "fusion_abs",
    ctes(*_BOTH, body=""",
s AS (SELECT qid, doc_id, floor((coalesce(a.score, 0.0) / (coalesce(a.score, 0.0) + 10.0::DOUBLE) + coalesce(b.score, 0.0)) * 1000000 + 0.5) / 1000000 AS score
  FROM bm25 a FULL JOIN dense b USING (qid, doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""),
)
def fusion_abs(spark, sf):
    """Saturated lexical score plus dense score."""
    return retrieval.fuse_absolute(_bm25(spark, sf), _dense(spark, sf), 10.0, 10)


_PEAK = """,
peaks AS (SELECT qid, floor((CASE WHEN arg_max(score, rank) > 0 THEN max(score) / arg_max(score, rank) ELSE 0.0 END) * 1000000 + 0.5) / 1000000 AS peak FROM bm25 WHERE rank <= 10 GROUP BY qid)"""


@query("gate_peak", ctes(*_BOTH, body=_SCALED + _PEAK + """
SELECT qid, doc_id, score, rank, true AS lexical FROM bm25 WHERE rank <= 10 AND qid IN (SELECT qid FROM peaks WHERE peak >= 1.5)
UNION ALL SELECT qid, doc_id, score, rank, false FROM minmaxed WHERE qid NOT IN (SELECT qid FROM peaks WHERE peak >= 1.5)"""))
def gate_peak(spark, sf):
    """The lexical list where its peak is sharp, the fused one elsewhere."""
    lexical = _bm25(spark, sf)
    short = lexical.where("rank <= 10").withColumn("lexical", F.lit(True))
    return retrieval.gated(short, _fused(spark, sf).withColumn("lexical", F.lit(False)), retrieval.peak_ratio(lexical), 1.5)


@query("peak_ratios", ctes(*_CHANNELS, body=_PEAK + " SELECT qid, peak FROM peaks"))
def peak_ratios(spark, sf):
    """Best over tenth score."""
    return retrieval.peak_ratio(_bm25(spark, sf))


_INTERLEAVED = """,
f AS (SELECT qid, doc_id, min(rank * 2 + c) AS pos FROM (SELECT qid, doc_id, rank, 0 AS c FROM bm25 UNION ALL SELECT qid, doc_id, rank, 1 FROM dense) GROUP BY ALL)
SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY pos) AS place FROM f) WHERE place <= 10"""


@query("candidate_interleave", ctes(*_BOTH, body=_INTERLEAVED))
def candidate_interleave(spark, sf):
    """Round robin of two rankings."""
    return retrieval.interleave(_bm25(spark, sf), _dense(spark, sf), 10)


def _position(spark, sf):
    return within(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "at")


@query("neighbor_pull", ctes(*_CHANNELS, body=""",
near AS (SELECT doc_id, lag(doc_id) OVER w AS a, lead(doc_id) OVER w AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
s AS (SELECT r.qid, r.doc_id, floor((r.score + 0.5::DOUBLE * coalesce(greatest(x.score, y.score), 0.0)) * 1000000 + 0.5) / 1000000 AS score
  FROM bm25 r JOIN near n USING (doc_id) LEFT JOIN bm25 x ON x.qid = r.qid AND x.doc_id = n.a LEFT JOIN bm25 y ON y.qid = r.qid AND y.doc_id = n.b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"""))
def neighbor_pull(spark, sf):
    """The better neighbour in the same source lends half of its score."""
    return retrieval.neighbour_boost(_bm25(spark, sf), _position(spark, sf), 0.5, 10)


@query("source_neighbors", """
SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS following, CAST(row_number() OVER w - 1 AS INTEGER) AS position
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def source_neighbors(spark, sf):
    """Neighbours and position inside the source, by places, so no task holds a source."""
    here = _position(spark, sf)
    beside = here.select(F.col("doc_id").alias("other"), F.col("source").alias("_source"), "at")
    side = lambda step, name: beside.select(F.col("other").alias(name), F.col("_source").alias(f"_{name}"), (F.col("at") + step).alias(f"at_{name}"))
    for step, name in ((1, "previous"), (-1, "following")):
        here = here.join(side(step, name), F.col("source").eqNullSafe(F.col(f"_{name}")) & (F.col("at") == F.col(f"at_{name}")), "left")
    return here.select("doc_id", "previous", "following", (F.col("at") - 1).alias("position"))


@query("prf_expand", ctes(*_CHANNELS, body=""",
found AS (SELECT DISTINCT qid, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*')) AS term FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 3),
counted AS (SELECT qid, term, count(*) AS docs FROM found f WHERE length(term) >= 4 AND NOT EXISTS (FROM questions q WHERE q.qid = f.qid AND q.term = f.term) GROUP BY ALL HAVING count(*) >= 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY docs DESC, term) AS rank FROM counted) WHERE rank <= 5"""))
def prf_expand(spark, sf):
    """Expansion terms from the three best documents."""
    return retrieval.feedback_terms(_bm25(spark, sf, 3), _docs(spark, sf), domain.questions(spark, sf))


@query("relevant_documents", ctes("gold", body=" SELECT qid, doc_id FROM gold"))
def relevant_documents(spark, sf):
    """Documents that contain a benchmark passage."""
    return domain.gold(spark, sf)


_OUTCOMES = """,
marked AS (SELECT g.qid, g.doc_id, b.rank FROM gold g LEFT JOIN bm25 b USING (qid, doc_id)),
outcomes AS (SELECT qid, count(*) AS refs, min(rank) AS best, count(*) FILTER (rank <= 1) AS hits1, count(*) FILTER (rank <= 3) AS hits3, count(*) FILTER (rank <= 5) AS hits5, count(*) FILTER (rank <= 10) AS hits10 FROM marked GROUP BY qid)"""


def _outcomes(spark, sf):
    return metrics.outcomes(_bm25(spark, sf), domain.gold(spark, sf))


@query("hit_outcomes", ctes(*_CHANNELS, "gold", body=_OUTCOMES + " SELECT * FROM outcomes"))
def hit_outcomes(spark, sf):
    """References, best rank and hits of each question."""
    return _outcomes(spark, sf)


@query("hit_metrics_by_lang", ctes(*_CHANNELS, "gold", body=_OUTCOMES + """,
layered AS (SELECT o.*, CASE WHEN o.qid % 2 = 0 THEN 'even' ELSE 'odd' END AS layer FROM outcomes o)
SELECT coalesce(layer, 'ALL') AS layer, count(*) AS questions, floor(avg(CAST(hits1 > 0 AS INTEGER)) * 10000 + 0.5) / 10000 AS hit1, floor(avg(CAST(hits3 > 0 AS INTEGER)) * 10000 + 0.5) / 10000 AS hit3,
  floor(avg(hits3 / 3.0::DOUBLE) * 10000 + 0.5) / 10000 AS p3, floor(avg(hits10 / refs::DOUBLE) * 10000 + 0.5) / 10000 AS r10, floor(avg(coalesce(1.0::DOUBLE / best, 0.0)) * 10000 + 0.5) / 10000 AS mrr
FROM layered GROUP BY GROUPING SETS ((layer), ())"""))
def hit_metrics_by_lang(spark, sf):
    """Metrics per layer and over all."""
    layer = F.when(F.col("qid") % 2 == 0, "even").otherwise("odd")
    return metrics.summary(_outcomes(spark, sf).withColumn("layer", layer), "layer")


@query("rank_buckets", ctes(*_CHANNELS, "gold", body=_OUTCOMES + """
SELECT CASE WHEN best IS NULL THEN 'none' WHEN best <= 3 THEN '1-3' WHEN best <= 10 THEN '4-10' ELSE '11-50' END AS bucket, count(*) AS questions FROM outcomes GROUP BY 1"""))
def rank_buckets(spark, sf):
    """Histogram of the first hit's rank."""
    bucket = F.when(F.col("best").isNull(), "none").when(F.col("best") <= 3, "1-3").when(F.col("best") <= 10, "4-10").otherwise("11-50")
    return _outcomes(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("questions"))


@query("failure_class", ctes(*_CHANNELS, "gold", body=_OUTCOMES + """
SELECT qid, CASE WHEN best IS NULL THEN 'not recalled' WHEN best <= 3 THEN 'hit' WHEN best <= 10 THEN 'near' ELSE 'far' END AS outcome FROM outcomes"""))
def failure_class(spark, sf):
    """Hit, near, far or not recalled."""
    return _outcomes(spark, sf).select("qid", F.when(F.col("best").isNull(), "not recalled").when(F.col("best") <= 3, "hit").when(F.col("best") <= 10, "near").otherwise("far").alias("outcome"))


@query("candidate_ceiling", ctes(*_CHANNELS, "gold", body=_OUTCOMES + """
SELECT CASE WHEN hits10 = refs THEN 'all' WHEN hits10 > 0 THEN 'some' ELSE 'none' END AS found, count(*) AS questions, CAST(sum(refs) AS BIGINT) AS refs FROM outcomes GROUP BY 1"""))
def candidate_ceiling(spark, sf):
    """How many questions have all, some or none of their references among ten candidates."""
    found = F.when(F.col("hits10") == F.col("refs"), "all").when(F.col("hits10") > 0, "some").otherwise("none")
    return _outcomes(spark, sf).groupBy(found.alias("found")).agg(F.count("*").alias("questions"), F.sum("refs").alias("refs"))


@query("coverage_waste", ctes(*_CHANNELS, "gold", body="""
SELECT b.doc_id, count(*) AS asked, count(g.doc_id) AS useful FROM bm25 b LEFT JOIN gold g USING (qid, doc_id) WHERE rank <= 10 GROUP BY b.doc_id HAVING count(*) >= 3"""))
def coverage_waste(spark, sf):
    """Documents that many questions find, and how often they are right."""
    useful = domain.gold(spark, sf).withColumn("useful", F.lit(1))
    joined = _bm25(spark, sf).where("rank <= 10").join(useful, ["qid", "doc_id"], "left")
    return joined.groupBy("doc_id").agg(F.count("*").alias("asked"), F.count("useful").alias("useful")).where("asked >= 3")


_SIGNAL = """,
signals AS (SELECT b.qid, b.score AS signal, EXISTS (FROM gold g WHERE g.qid = b.qid) AS answerable FROM bm25 b WHERE rank = 1)"""


def _signal(spark, sf):
    answerable = domain.gold(spark, sf).select("qid").distinct().withColumn("answerable", F.lit(True))
    best = _bm25(spark, sf, 1).select("qid", F.col("score").alias("signal"))
    return best.join(answerable, "qid", "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))


@query("refusal_sweep", ctes(*_CHANNELS, "gold", body=_SIGNAL + """
SELECT t::DOUBLE AS threshold, count(*) FILTER (NOT answerable AND signal < t) AS rejected, count(*) FILTER (answerable AND signal < t) AS false_rejects,
  floor(((count(*) FILTER (NOT answerable AND signal < t))::DOUBLE / (count(*) FILTER (NOT answerable)) + 1 - (count(*) FILTER (answerable AND signal < t))::DOUBLE / (count(*) FILTER (answerable))) / 2 * 10000 + 0.5) / 10000 AS balanced_accuracy
FROM signals CROSS JOIN (SELECT unnest([20.0, 25.0, 30.0, 35.0, 40.0, 50.0]) AS t) GROUP BY t"""))
def refusal_sweep(spark, sf):
    """Thresholds on the best score."""
    return metrics.threshold_sweep(_signal(spark, sf), [20, 25, 30, 35, 40, 50])


@query("refusal_separation", ctes(*_CHANNELS, "gold", body=_SIGNAL + """
SELECT answerable, count(*) AS questions, min(signal) AS low, quantile_disc(signal, 0.5) AS middle, max(signal) AS high FROM signals GROUP BY answerable"""))
def refusal_separation(spark, sf):
    """The signal's range with and without an answer."""
    return _signal(spark, sf).groupBy("answerable").agg(F.count("*").alias("questions"), F.min("signal").alias("low"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY signal)").alias("middle"), F.max("signal").alias("high"))


@query("quartile_threshold", ctes(*_CHANNELS, body=" SELECT quantile_disc(score, 0.25) AS threshold FROM bm25 WHERE rank = 1"))
def quartile_threshold(spark, sf):
    """The lower quartile of the best scores."""
    return _bm25(spark, sf, 1).agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY score)").alias("threshold"))


@query("pairwise_cosine", """
WITH s AS (SELECT vec_id, embedding, label FROM embeddings)
SELECT a.label, count(*) AS pairs, floor(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) * 1000 + 0.5) / 1000 AS mean
FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def pairwise_cosine(spark, sf):
    """Mean cosine of all pairs of a label, from the sum of its unit vectors: |sum|^2 = n + 2 * (sum over pairs)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = table(spark, sf, "embeddings").select("label", "embedding", norm.alias("norm")).where("norm > 0")
    sums = rows.select("label", "norm", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.sum(F.col("x").cast("double") / F.col("norm")).alias("t"))
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    square = sums.groupBy("label").agg(F.sum(F.col("t") * F.col("t")).alias("square")).join(n, "label").where("n > 1")
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return square.select("label", pairs.alias("pairs"), half_up((F.col("square") - F.col("n")) / 2 / pairs, 3).alias("mean"))


@query("weight_sweep", ctes(*_BOTH, "gold", body=""",
v AS (SELECT w, qid, doc_id, floor(sum(v) * 1000000000 + 0.5) / 1000000000 AS score FROM (
  SELECT w, qid, doc_id, w / (60 + rank) AS v FROM bm25 CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS w)
  UNION ALL SELECT w, qid, doc_id, (1 - w) / (60 + rank) FROM dense CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS w)) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY w, qid ORDER BY score DESC, doc_id) AS rank FROM v)
SELECT w AS weight, count(*) AS refs, count(*) FILTER (rank <= 10) AS found, floor(avg(coalesce(1.0::DOUBLE / rank, 0.0)) * 10000 + 0.5) / 10000 AS mrr
FROM (SELECT w, qid, doc_id FROM gold CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS w)) LEFT JOIN r USING (w, qid, doc_id) GROUP BY w"""))
def weight_sweep(spark, sf):
    """Reciprocal rank fusion over a grid of weights."""
    # DEPTH rows a question each; settled, as the searches would run again for each weight.
    lexical, dense, gold = settled(_bm25(spark, sf)), settled(_dense(spark, sf)), domain.gold(spark, sf)
    found = None
    for w in (0.2, 0.5, 0.8):
        fused = retrieval.fuse_ranks([(lexical, w), (dense, 1 - w)], 60, 1_000_000)
        row = gold.join(fused, ["qid", "doc_id"], "left").agg(F.lit(w).alias("weight"), F.count("*").alias("refs"), F.count_if(F.col("rank") <= 10).alias("found"), half_up(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))
        found = row if found is None else found.union(row)
    return found


@query("rerank_fill", ctes(*_CHANNELS, body=""",
picks AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank DESC) AS place FROM bm25 WHERE rank IN (3, 5)),
allp AS (SELECT * FROM picks UNION ALL SELECT qid, doc_id, rank + 1000000 FROM bm25 b WHERE NOT EXISTS (FROM picks p WHERE p.qid = b.qid AND p.doc_id = b.doc_id))
SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM allp) WHERE rank <= 5"""))
def rerank_fill(spark, sf):
    """Picks of a reranker first, then the ranking."""
    ranking = _bm25(spark, sf)
    picks = ranking.where("rank in (3, 5)").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank"))))
    return retrieval.filled_picks(picks, ranking, 5)


@query("run_hit_matrix", ctes(*_BOTH, "gold", body="""
SELECT g.qid, count(*) FILTER (b.rank <= 10) AS bm25, count(*) FILTER (d.rank <= 10) AS dense FROM gold g LEFT JOIN bm25 b USING (qid, doc_id) LEFT JOIN dense d USING (qid, doc_id) GROUP BY g.qid"""))
def run_hit_matrix(spark, sf):
    """Hits of each question in each run."""
    runs = _bm25(spark, sf).withColumn("run", F.lit("bm25")).unionByName(_dense(spark, sf).withColumn("run", F.lit("dense")))
    gold = domain.gold(spark, sf)
    hits = gold.join(runs.where("rank <= 10"), ["qid", "doc_id"]).groupBy("qid").pivot("run", ["bm25", "dense"]).agg(F.count("rank"))
    return gold.select("qid").distinct().join(hits, "qid", "left").na.fill(0, ["bm25", "dense"])


@query("gained_lost", ctes(*_BOTH, body="""
SELECT 'gained' AS change, qid, doc_id FROM (SELECT qid, doc_id FROM dense WHERE rank <= 3 EXCEPT SELECT qid, doc_id FROM bm25 WHERE rank <= 3)
UNION ALL SELECT 'lost', qid, doc_id FROM (SELECT qid, doc_id FROM bm25 WHERE rank <= 3 EXCEPT SELECT qid, doc_id FROM dense WHERE rank <= 3)"""))
def gained_lost(spark, sf):
    """What one run has and the other has not."""
    a, b = (r.where("rank <= 3").select("qid", "doc_id") for r in (_bm25(spark, sf), _dense(spark, sf)))
    return b.exceptAll(a).select(F.lit("gained").alias("change"), "*").union(a.exceptAll(b).select(F.lit("lost"), "*"))


@query("leak_check", ctes("gold", body=" SELECT (g.doc_id % 5) AS fold, count(*) AS refs, count(DISTINCT g.doc_id) AS documents, count(*) FILTER (g.doc_id IN (SELECT doc_id FROM labels)) AS cited FROM gold g GROUP BY 1"))
def leak_check(spark, sf):
    """References that a cited set holds."""
    cited = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("cited"))
    joined = domain.gold(spark, sf).join(cited, "doc_id", "left")
    return joined.groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.count("*").alias("refs"), F.countDistinct("doc_id").alias("documents"), F.count("cited").alias("cited"))


@query("paraphrase_rule", ctes("questions", body="""
SELECT a.item_id AS qid, count(*) FILTER (contains(lower(a.text), q.term)) AS shared, count(*) AS terms FROM benchmark a JOIN questions q ON q.qid = a.item_id + 1 GROUP BY 1"""))
def paraphrase_rule(spark, sf):
    """Anchors of the next question that a text contains."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    joined = domain.questions(spark, sf).withColumn("qid", F.col("qid") - 1).join(items, "qid")
    return joined.groupBy("qid").agg(F.count_if(F.contains(F.lower("text"), "term")).alias("shared"), F.count("*").alias("terms"))


@query("field_weighted_size", "SELECT doc_id, CAST(3 * len(regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9][a-z0-9+._#-]*')) + len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*')) AS INTEGER) AS size FROM documents")
def field_weighted_size(spark, sf):
    """Heading fields count three times."""
    weighted = F.concat_ws(" ", F.repeat(F.concat_ws(" ", "source", "lang", F.lit("")), F.lit(3)), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(latin_tokens(weighted)).alias("size"))


@query("tokenizer_modes", """
WITH t AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+._#-]*')) AS latin, length(regexp_replace(lower(text), '[ \t\n\r\v\f]+', '', 'g')) AS solid FROM documents)
SELECT doc_id, CAST(latin AS INTEGER) AS latin, CAST(CASE WHEN solid < 2 THEN 1 ELSE solid - 1 END AS INTEGER) AS bigram, CAST(latin + CASE WHEN solid < 2 THEN 1 ELSE solid - 1 END AS INTEGER) AS hybrid FROM t""")
def tokenizer_modes(spark, sf):
    """Tokens of each tokenizer mode."""
    return table(spark, sf, "documents").select("doc_id", *[F.size(tokens("text", m)).alias(m) for m in ("latin", "bigram", "hybrid")])
