"""Operators on small hand-written tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.functions import text as T
from tessera.operators import alignment, checkpoints, containment, folds, graph, html, ledger, metrics, picking, retrieval
from tessera.operators.ordering import numbered
from tessera.sources import readers, sinks
from tessera.streaming import ledger as streaming


def _set(df, *columns):
    return {tuple(r) for r in df.select(*(columns or df.columns)).collect()}


def test_bm25_repeated_terms_absent_terms_and_ties(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, "blue"), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red"), (2, "red"), (2, "red"), (3, "absent")], "qid long, term string")
    found = {(r.qid, r.doc_id): (r.score, r.rank) for r in retrieval.bm25(docs, asked, 5).collect()}
    assert set(found) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert found[1, 1][1] == 1 and found[1, 2][1] == 2 and found[1, 1][0] == found[1, 2][0]
    assert found[2, 1][0] == pytest.approx(2 * found[1, 1][0], abs=0.002)


def test_fusion_of_constant_and_missing_channels(spark):
    a = spark.createDataFrame([(1, 1, 5.0, 1), (1, 2, 5.0, 2)], "qid long, doc_id long, score double, rank int")
    b = spark.createDataFrame([(1, 3, 1.0, 1), (1, 2, 0.0, 2)], "qid long, doc_id long, score double, rank int")
    assert _set(retrieval.minmax(a), "doc_id", "score") == {(1, 0.0), (2, 0.0)}
    assert _set(retrieval.fuse_scores(a, b, 0.35, 5), "doc_id", "score", "rank") == {(3, 0.65, 1), (1, 0.0, 2), (2, 0.0, 3)}
    assert _set(retrieval.interleave(a, b, 3), "doc_id", "place") == {(1, 1), (3, 2), (2, 3)}


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 4), (2, 12, 2)], "qid long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 99), (2, 12), (3, 5)], "qid long, doc_id long")
    found = metrics.summary(metrics.outcomes(ranking, gold).withColumn("layer", F.lit("x")), "layer")
    row = found.where("layer = 'ALL'").first()
    assert (row.questions, row.hit1, row.hit3, row.mrr) == (3, 0.0, 0.3333, 0.25)


def test_graph_on_diamond_chain_and_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "src long, dst long")
    assert {(r.src, r.dst): r.depth for r in graph.closure(edges).collect()}[1, 5] == 3
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    assert _set(graph.depths(nodes, edges)) == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 0)}
    assert graph.cyclic(edges).count() == 0
    assert _set(graph.cyclic(edges.union(spark.createDataFrame([(5, 3)], "src long, dst long")))) == {(3,), (4,), (5,)}
    seeds = spark.createDataFrame([(5,)], "seed long")
    assert _set(graph.hops(edges, seeds, 2), "node", "hop") == {(5, 0), (4, 1), (2, 2), (3, 2)}
    assert graph.dangling(edges, nodes.where("node < 5")).count() == 1


def test_text_functions(spark):
    row = spark.range(1).select(
        T.latin_tokens(F.lit("C++ and node.js -x 3d")).alias("latin"),
        T.bigrams(F.lit("a bc")).alias("pairs"),
        T.bigrams(F.lit("x")).alias("one"),
        T.normalised(F.lit("  A（b）  C ")).alias("n"),
        T.normalised_url(F.lit("HTTPS://www.A.com/x/?q=1#t")).alias("url"),
        T.slug(F.lit("--A b/C!")).alias("slug"),
        T.han_ratio(F.lit("中a 文b")).alias("han"),
        T.fnv1a(F.lit("abc")).alias("fnv"),
        T.containment(F.lit("abc"), F.lit("xabcx")).alias("inside"),
        T.half_up(F.lit(-0.0005), 3).alias("half"),
    ).first()
    assert row.latin == ["c++", "and", "node.js", "x", "3d"] and row.pairs == ["ab", "bc"] and row.one == ["x"]
    assert (row.n, row.url, row.slug, row.han, row.fnv, row.inside, row.half) == ("a(b) c", "a.com/x", "a-b-c", 0.5, 0x1A47E90B, 1.0, 0.0)


def test_numbering_over_partitions(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    assert all(r.number == r.x + 1 for r in numbered(rows, ["x"]).collect())
    assert numbered(rows.limit(0), ["x"]).count() == 0


def test_html_blocks():
    page = '<html><head><title> A\n b </title><script>var t="</p>";</script></head><body><nav><li>menu</li></nav><h2>Top</h2><p>one <b>two</b><p>three<ul><li>x<li>xy</ul><pre>a\n  b</pre>tail &amp; end<footer>no</footer>'
    assert [(b["kind"], b["level"], b["text"]) for b in html.blocks_of(page)] == [("heading", 2, "Top"), ("text", 0, "one two"), ("text", 0, "three"), ("list", 0, "xy"), ("code", 0, "a\n  b"), ("text", 0, "tail & end")]
    assert html.blocks_of(None) == [] and html.blocks_of("") == []


def test_html_markers_lists_and_short_texts():
    page = (
        '<body><div class="page-sidebar">side <div>inner</div> still side</div><div id="cookie-consent">ok?</div><div role="breadcrumb">home</div>'
        '<img class="advert"><h1>T</h1><p>- a point<p>1. first</p><p>2) second</p><p>x</p><p>sidebarred text stays</p><p class="considebar">kept too</p></body>'
    )
    assert [(b["kind"], b["text"]) for b in html.blocks_of(page)] == [("heading", "T"), ("list", "- a point"), ("list", "1. first"), ("list", "2) second"), ("text", "sidebarred text stays"), ("text", "kept too")]
    assert ("text", "still side") in [(b["kind"], b["text"]) for b in html.blocks_of(page, boilerplate=True)]


def test_titles_and_dates(spark):
    graph_ = '{"@graph": [{"@type": "Person", "datePublished": "1999-01-01"}, {"@type": ["Thing", "Report"], "datePublished": " 2024-05-06T01:02", "part": {"@type": "WebPage", "dateModified": "2024-06-07"}}]}'
    pages = [
        (1, f'<TITLE x> A &amp; B\n b &eacute;&#33; </title><script type="application/ld+json">{graph_}</script>'),
        (2, '<script type="application/ld+json">{bad</script><p>datePublished: "2020-01-01"</p>'),
        (3, '<script type="application/ld+json">[{"@type": "Article", "datePublished": 7}, {"@type": "Article", "datePublished": "2001-02-03"}]</script>'),
        (4, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    assert [tuple(r) for r in html.stated_dates(df).orderBy("page_id").collect()] == [(1, "2024-05-06", "2024-06-07", 2), (2, None, None, 0), (3, "2001-02-03", None, 2), (4, None, None, 0)]
    assert [r.t for r in df.orderBy("page_id").select(html.title("html").alias("t")).collect()] == ["A & B b é!", "", "", None]


def test_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 91)], "src long, dst long")
    nodes = spark.range(1, 92).withColumnRenamed("id", "node")
    assert _set(graph.depths(nodes, chain), "node", "depth") == {(i, i - 1) for i in range(1, 92)}
    found = graph.closure(chain.where("src <= 70")).where("src = 1").collect()
    assert {(r.dst, r.depth) for r in found} == {(i, i - 1) for i in range(2, 72)}
    back = chain.union(spark.createDataFrame([(60, 40)], "src long, dst long"))
    for f in (graph.closure, lambda e: graph.depths(nodes, e)):
        with pytest.raises(ValueError, match="cycle"):
            f(back).collect()
    assert graph.closure(chain.limit(0)).count() == 0


def test_contained_passages_of_any_length(spark):
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x" + " ".join(words[10:40])), (3, "ab"), (4, None)], "doc_id long, text string")
    items = {1: "w10 w11 w12 w13 w14 w15 w16", 2: "w2998 w2999", 3: "0 w11 w12 w", 4: "b", 5: "w5 w6 w7", 6: "absent", 7: "", 8: "w20 w22 w23 w24 w25 w26"}
    found = _set(containment.contained(docs, spark.createDataFrame(list(items.items()), "item long, passage string")), "doc_id", "item")
    assert found == {(d, i) for d, t in ((1, " ".join(words)), (2, "x" + " ".join(words[10:40])), (3, "ab")) for i, p in items.items() if p and p in t}


def test_greedy_pairs_equal_one_by_one(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(40), 100 + rng.randrange(40), rng.randrange(5)) for _ in range(200)]
    taken, used = set(), set()
    for a, b, cost in sorted(set(pairs), key=lambda p: (p[2], p[0], p[1])):
        if a not in used and b not in used:
            taken.add((a, b))
            used |= {a, b}
    df = spark.createDataFrame(sorted(set(pairs)), "a long, b long, cost long")
    assert _set(picking.without_reuse(df, ["cost"]), "a", "b") == taken


def test_kept_tables_follow_their_sources(spark, tmp_path):
    source, made = str(tmp_path / "in"), []

    def kept():
        return checkpoints.kept(spark, "rows", [source], lambda: made.append(1) or spark.read.parquet(source))

    spark.range(3).write.parquet(source)
    assert kept().count() == 3 and kept().count() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert kept().count() == 5 and len(made) == 2


def test_chunks(spark):
    texts = ["aaa. bbb ccc\n\nddd eee fff ggg. hhh\niii jjj", "x" * 25, "", "é\U0001f600" * 40, "one\n \ntwo three"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", "text", chunking.recursive("text", 6).alias("r"), chunking.windows("text", 10, 4).alias("w"), chunking.paragraphs("text", 5).alias("p"))
    for r in rows.collect():
        assert "".join(r.r) == r.text and all(0 < len(x) <= 6 for x in r.r)
        starts = [0]
        while starts[-1] + 10 < len(r.text):
            starts.append(starts[-1] + 6)
        assert [(x.start, x.text) for x in r.w] == ([(s, r.text[s : s + 10]) for s in starts] if r.text else [])
        assert all(len(x) <= 5 for x in r.p)
    assert rows.where("i = 4").first().p == ["one", "two t", "hree"]


def test_alignment_equals_all_pairs(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(2, 14))) for _ in range(80)]
    pairs = lambda t: {s[i : i + 2] for s in [t.replace(" ", "").lower()] for i in range(max(1, len(s) - 1))}
    left, right = list(enumerate(texts[:30])), [(100 + i, t) for i, t in enumerate(dict.fromkeys(texts[25:]))]
    want = {}
    for i, t in left:
        equal = [o for o, u in right if u == t]
        near = sorted((-len(pairs(t) & pairs(u)) / len(pairs(t)), o) for o, u in right if len(t) / 2 <= len(u) <= 2 * len(t))
        near = [(r, o) for r, o in near if -r >= 0.6]
        if equal or near:
            want[i] = (min(equal), 1.0) if equal else (near[0][1], -near[0][0])
    found = alignment.aligned(spark.createDataFrame(left, "item long, text string"), spark.createDataFrame(right, "other long, text string"))
    assert {r.item: (r.other, r.ratio) for r in found.collect()} == want


def test_folds(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 4, 4, 9, 1])], "g long, o int, n long")
    assert sorted((r.o, r.parent) for r in folds.reset_pack(rows, "g", "o", F.col("n"), 8).collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    docs = spark.createDataFrame([("s", i, "ab"[i % 2], 100 - i) for i in range(10)], "source string, doc_id long, lang string, n_chars long")
    assert sorted((r.place, r.doc_id) for r in folds.greedy_quota(docs, "source", "n_chars", "doc_id", "lang", 4, 1).collect()) == [(1, 0), (2, 1)]


def test_ledger(spark):
    e = spark.createDataFrame([(1, 1, "candidate", "a"), (1, 2, "confirm", "-"), (1, 3, "candidate", "b"), (2, 1, "candidate", "c"), (2, 2, "candidate", "d"), (3, 1, "confirm", "-")], "k long, t long, action string, v string")
    assert _set(ledger.confirmed_state(e, "k", ["t"], "action", "v")) == {(1, "confirmed", "a"), (2, "candidate", "d")}
    assert _set(ledger.latest(e, ["k"], ["t"], ["v"])) == {(1, "b", 3), (2, "d", 2), (3, "-", 1)}
    assert _set(ledger.first_only(e, ["k", "action"], ["t"], ["v"]), "k", "v") == {(1, "a"), (1, "-"), (2, "c"), (3, "-")}
    page = ledger.page(e, [F.col("k"), F.col("t")], 4, 4).collect()
    assert len(page) == 2 and page[0].total == 6 and not page[0].has_more
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 1, "x"), (1, 4, "y"), (1, 6, "z")], "k long, t long, s string")
    assert _set(ledger.as_of(left, right, "k", "t", "s"), "k", "t", "s") == {(1, 5, "y"), (1, 1, "x"), (2, 9, None)}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"recordType":"node","id":"n1"}\n\n{"recordType":"edge","id":"e1"}\n')
    rows = readers.json_lines(spark, str(tmp_path / "in/a.jsonl"), "recordType string, id string").where("id is not null")
    nodes, edges = readers.split_records(rows)
    assert _set(nodes, "id") == {("n1",)} and _set(edges, "id") == {("e1",)}
    (tmp_path / "x.json").write_text(json.dumps({"meta": {"v": 1}, "nodes": [{"id": "a"}], "edges": [{"src": "a", "dst": "b"}]}))
    parts = readers.json_sections(spark, str(tmp_path / "x.json"), "meta struct<v:int>, nodes array<struct<id:string>>, edges array<struct<src:string,dst:string>>")
    assert set(parts) == {"nodes", "edges"} and _set(parts["edges"]) == {("a", "b")}
    (tmp_path / "t.tsv").write_text("﻿Code\tTitle\n1\tA \"q\"\n2\t\n")
    assert _set(readers.tsv(spark, str(tmp_path / "t.tsv"), ["Code", "Title"])) == {("1", 'A "q"'), ("2", "")}
    (tmp_path / "mix").mkdir()
    (tmp_path / "mix/a.csv").write_text("id,x\n1,2\n")
    (tmp_path / "mix/b.json").write_text('[{"id": 2}]')
    (tmp_path / "mix/c.jsonl").write_text('{"id": 3, "y": 1}\n{"id": 4}\n')
    assert _set(readers.mixed_folder(spark, str(tmp_path / "mix")), "id", "format") == {("1", "csv"), ("2", "json"), ("3", "jsonl"), ("4", "jsonl")}
    lines = spark.createDataFrame([("2024", "080901 Computing\nnoise\n 120203K  Accounting ")], "page string, text string")
    assert _set(readers.table_lines(lines), "code", "name") == {("080901", "Computing"), ("120203K", "Accounting")}
    (tmp_path / "std").mkdir()
    for i in (1, 2):
        (tmp_path / f"std/s{i}.json").write_text(json.dumps({"standardId": f"s{i}", "rows": [{"code": str(i)}]}, indent=1))
    side = spark.createDataFrame([("s1", "first")], "standardId string, title string")
    assert _set(readers.standards(spark, str(tmp_path / "std/*.json"), "standardId string, rows array<struct<code:string>>", side), "file", "title") == {("s1", "first"), ("s2", None)}
    sinks.json_lines(spark.createDataFrame([("b", None, 1)], "b string, a string, c int"), str(tmp_path / "out"), ["c", "a", "b"])
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == '{"c":1,"b":"b"}\n'
    manifest = sinks.batches(spark.range(25).coalesce(1), str(tmp_path / "b"), 10)
    assert sorted(r.rows for r in manifest.collect()) == [5, 10, 10]
    sinks.vectors(spark.createDataFrame([("m1", 1), ("m2", 2)], "model string, id long"), str(tmp_path / "v"))
    sinks.vectors(spark.createDataFrame([("m1", 3)], "model string, id long"), str(tmp_path / "v"))
    assert _set(readers.vectors(spark, str(tmp_path / "v"), "m1"), "id") == {(3,)} and _set(readers.vectors(spark, str(tmp_path / "v"), "m2"), "id") == {(2,)}
    page = spark.createDataFrame([("t", 3)], "title string, n int").select(sinks.front_matter({"title": F.col("title"), "n": F.col("n")}, F.lit("body")).alias("p")).first().p
    assert page == '---\ntitle: "t"\nn: 3\n---\n\nbody'


def test_streams(spark, tmp_path):
    schema = "id long, user long, ts timestamp, kind string"
    t = dt.datetime(2024, 1, 1)
    for n, rows in enumerate([[(1, 1, t, "a"), (2, 1, t, "b"), (1, 1, t, "a")], [(3, 2, t + dt.timedelta(minutes=1), "c"), (2, 1, t, "b"), (4, 1, t + dt.timedelta(minutes=2), "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    once: list = []
    streaming.run_available(streaming.append_once(stream(), ["id"], "ts", "1 hour"), lambda b, n: once.extend(r.id for r in b.collect()), str(tmp_path / "c1"))
    assert sorted(once) == [1, 2, 3, 4]
    streaming.keep_latest(stream(), ["user"], ["ts", "id"], ["kind"], str(tmp_path / "state"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert _set(spark.read.parquet(str(last)), "user", "kind") == {(1, "d"), (2, "c")}
    counts: list = []
    streaming.run_available(streaming.windowed_counts(stream(), "ts", "0 seconds", "1 minute"), lambda b, n: counts.extend(b.collect()), str(tmp_path / "c3"))
    assert all(r.n > 0 for r in counts)


def test_fused_ranks_have_each_document_once(spark):
    """Rankings that several fusions read again, in which a union must not be taken as dealt by question."""
    rng = random.Random(4)
    rows = [(q, d, rng.random()) for q in range(40) for d in rng.sample(range(400), 60)]
    table = spark.createDataFrame(rows, "qid long, doc_id long, score double")
    a, b = retrieval.top(table, 50), retrieval.top(table.withColumn("score", -F.col("score")), 50)
    gold = spark.createDataFrame([(q, d) for q, d, _ in rows[:: 7]], "qid long, doc_id long")
    found = None
    for w in (0.2, 0.5, 0.8):
        fused = retrieval.fuse_ranks([(a, w), (b, 1 - w)], 60, 1_000_000)
        row = gold.join(fused, ["qid", "doc_id"], "left").agg(F.count("*").alias("refs"))
        found = row if found is None else found.union(row)
    assert {r.refs for r in found.collect()} == {gold.count()}
