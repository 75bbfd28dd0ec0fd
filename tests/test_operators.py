"""Hand-made rows for the operators' edge cases."""

import math
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from factloom.functions.scores import GRID, STEP, agreement_zone, score_band, thresholds_passed
from factloom.functions.text import any_keyword, context_snippet, html_unescape, is_blank, normalized_id, slugify, strip
from factloom.operators import extract, graph, grounding, judge, resolve, stats, texts
from factloom.providers import HashedNgramEmbedder, LexicalJudge, ModelJudge, RateGate, SuffixExtractor
from factloom.schemas import canonical_label, relation_templates


def column(spark, values, kind, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.o for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_text_functions(spark):
    assert column(spark, [None, "", "!!", "Über Größe", "場", "--A  b--"], "string", slugify) == ["", "", "", "ber-gr-e", "", "a-b"]
    assert column(spark, ["A b"], "string", lambda c: normalized_id(c, F.lit("X"))) == ["a-b::X"]
    assert column(spark, [" \t x \n", "x", " "], "string", strip) == ["x", "x", ""]
    assert column(spark, [None, "", "  \t", "x"], "string", is_blank) == [True, True, True, False]
    assert column(spark, ["Big APPLE pie", "a.c", "abc", "\\E"], "string", lambda c: any_keyword(c, ["apple", "A.C", "\\E"])) == [True, True, False, True]
    assert column(spark, ["a &amp;lt; b &quot;", None], "string", html_unescape) == ['a &lt; b "', None]
    snippet = lambda c: context_snippet(c, F.lit("Name"), 10)
    assert column(spark, ["xxxxxxxx name yyyyyyyyy", "name at the start", "nothing in this text", "", None], "string", snippet) == ["xxxx name yyyy", "name at t", "nothing in", "", ""]


def test_scores(spark):
    scores = [-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0, -1.01, 1.01, math.nan, None]
    bands = column(spark, scores, "double", score_band)
    assert bands == ["Very Low", "Very Low", "Low", "Uncertain (−)", "Uncertain (+)", "Moderate High", "Very High", None, None, None, None]
    assert column(spark, scores, "double", agreement_zone) == ["disagree", "disagree", "uncertain", "uncertain", "uncertain", "agree", "agree", None, None, None, None]
    values = [k * STEP for k in range(GRID)] + [math.nextafter(k * STEP, -1) for k in range(GRID)] + [5.0, -5.0]
    assert column(spark, values, "double", thresholds_passed) == [sum(v >= k * STEP for k in range(GRID)) for v in values]


def test_loader_order_of_steps(spark, rows):
    df = spark.createDataFrame([(1, "Apple story"), (2, "story. To contact the reporter on Apple"), (3, None), (4, " "), (5, "To contact the reporters: x")], "k int, text string")
    cfg = texts.LoaderConfig(clean_regex=texts.BOILERPLATE, keywords=["apple"])
    assert rows(texts.load_texts(df, "k", cfg)) == [(1, "Apple story")]
    assert rows(texts.load_texts(df, "k", texts.LoaderConfig(clean_regex=texts.BOILERPLATE)))[2] == (5, "")
    many = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "k int, text string")
    assert [texts.load_texts(many, "k", texts.LoaderConfig(max_texts=n)).count() for n in (None, 0, 5, 20, 50)] == [20, 20, 5, 20, 20]


def test_documents_and_index(spark, rows):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["b", "a", "b", "c", "a", "b"])], "k long, text string")
    assert rows(texts.build_documents(df, "k", offset=7).select("k", "text", "idx")) == [(0, "b", 7), (1, "a", 8), (3, "c", 9)]
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert all(r.k == r.idx for r in texts.dense_index(many, "k").collect())
    assert texts.dense_index(many.limit(0), "k").count() == 0


def test_chunks(spark):
    docs = spark.createDataFrame([("s", 0, "word " * 900), ("s", 1, " "), (None, 2, "𝒜" * 3000), ("s", 3, "short")], "source string, idx int, text string")
    parents = {r.idx: r.text for r in docs.collect()}
    out = texts.chunk_documents(docs, 64, 6).orderBy("idx", "chunk_index").collect()
    assert {r.idx for r in out} == {0, 2, 3} and {r.parent_id for r in out} == {"s-0", "doc-2", "s-3"}
    for r in out:
        assert r.page_content == parents[r.idx][r.chunk_start : r.chunk_end] and len(r.page_content) <= 256
    for i in (0, 2, 3):
        own = [r for r in out if r.idx == i]
        assert own[0].chunk_start == 0 and own[-1].chunk_end == len(parents[i]) == own[0].parent_len
        assert all(a.chunk_start < b.chunk_start <= a.chunk_end for a, b in zip(own, own[1:]))
    with pytest.raises(ValueError):
        texts.word_windows(docs, "idx", "text", 5, 5)


def graph_tables(spark):
    chunks = spark.createDataFrame([(1, "Ann Lee works for Acme Corp. Ann Lee is a person."), (2, "Nothing here")], "chunk_id long, page_content string")
    nodes = spark.createDataFrame(
        [(1, 1, "ann", "Person", "Ann Lee"), (1, 2, "acme", "Organization", "Acme Corp"), (1, 3, "x", "Alien", "X"), (1, 4, "n", "Person", None), (1, 5, None, "Person", "Bob"), (1, 6, "m", None, "M"), (2, 7, "acme", "Organization", "Acme Corp"), (1, 8, "ann", "Person", "Second"), (9, 9, "lost", "Person", "No chunk")],
        "chunk_id long, pos long, id string, label string, name string",
    )
    rels = spark.createDataFrame([(1, 1, "ann", "WORKS_FOR", "acme"), (1, 2, "ann", "SINGS", "acme"), (1, 3, "ann", None, "acme"), (1, 4, "ann", "WORKS_FOR", "nobody"), (2, 5, "acme", "FOUNDED", "acme")], "chunk_id long, pos long, src_id string, rtype string, tgt_id string")
    return nodes, rels, chunks


def test_validation_modes(spark):
    nodes, rels, chunks = graph_tables(spark)
    n, r = judge.validate_graph(nodes, rels, chunks, LexicalJudge(), judge.JudgeConfig("filter", 0.5, 0.5))
    state = {x.pos: (x.disposition, x.kept, x.accepted) for x in n.collect()}
    assert {k: state[k] for k in (1, 3, 6, 7)} == {1: ("scored", True, True), 3: ("untemplated", True, False), 6: ("incomplete", False, False), 7: ("scored", False, False)}
    assert state[2][0] == state[4][0] == state[5][0] == "scored" and 9 not in state
    rel = {x.pos: (x.disposition, x.kept) for x in r.collect()}
    assert rel[4] == ("dangling", False) and rel[3] == ("incomplete", False) and rel[5] == ("dangling", False)
    n, r = judge.validate_graph(nodes, rels, chunks, LexicalJudge(), judge.JudgeConfig("annotate", 0.5, 0.5))
    assert all(x.kept for x in n.collect()) and n.count() == 8
    facts = {x.pos: (x.disposition, x.fact, x.kept) for x in r.collect()}
    assert facts[1] == ("scored", "Ann Lee works for Acme Corp.", True) and facts[2][0] == "untemplated" and facts[4][1] == "Ann Lee works for nobody."
    with pytest.raises(ValueError):
        judge.JudgeConfig("Review")


def test_template_parts_keep_placeholders_in_names(spark):
    t = relation_templates(spark, {"R": "{src} likes {tgt}!"}).collect()[0]
    assert (t.prefix, t.infix, t.suffix) == ("", " likes ", "!")


def test_model_judge_scores_pairs_once_and_survives_errors(spark):
    def load():
        def model(evidence, facts):
            if "bad" in facts:
                raise ValueError
            return [0.5] * len(facts)

        return model

    df = spark.createDataFrame([(1, "e", "good"), (2, "e", "good"), (3, None, "bad"), (4, "e", None)], "k int, evidence string, fact string")
    out = {r.k: (r.score, r.score_error) for r in ModelJudge(load, 1).score(df, "evidence", "fact", "score").collect()}
    assert out == {1: (0.5, False), 2: (0.5, False), 3: (0.0, True), 4: (None, None)}


def test_extraction_keeps_evidence_and_reports_failures(spark):
    class Fails(SuffixExtractor):
        def extract(self, texts):
            if any("fail" in t for t in texts):
                raise RuntimeError
            return super().extract(texts)

    chunks = spark.createDataFrame([(1, "Acme Steel Company rose."), (2, "fail"), (3, "no names")], "chunk_id long, page_content string")
    out = extract.extract_mentions(chunks, Fails(), shard_size=1, concurrency=2)
    assert [(r.chunk_id, r.id, r.failed) for r in out.orderBy("chunk_id").collect()] == [(1, "acme-steel-company::Organization", False), (2, None, True)]
    assert tuple(extract.extraction_summary(out).collect()[0]) == (1, 1, 1)
    assert column(spark, ["government body", "x", None], "string", canonical_label) == ["Government Body", "x", None]
    gate = RateGate(6000)
    gate.wait(), gate.wait()
    assert gate.gap == 0.01


def brute_communities(vectors, threshold):
    near = {k: {j for j, (m, w) in vectors.items() if m == lab and (j == k or sum(x * y for x, y in zip(v, w)) >= threshold)} for k, (lab, v) in vectors.items()}
    taken = {}
    for k in sorted(near, key=lambda k: (-len(near[k]), k)):
        for j in near[k]:
            taken.setdefault(j, k)
    return taken


def test_communities_as_by_greedy(spark):
    import random

    rng = random.Random(3)
    vectors = {}
    for k in range(60):
        v = [rng.gauss(0, 1) for _ in range(3)]
        n = math.sqrt(sum(x * x for x in v))
        vectors[k] = (k % 2, [x / n for x in v])
    df = spark.createDataFrame([(k, lab, v) for k, (lab, v) in vectors.items()] + [(99, 0, None)], "id long, label int, v array<double>")
    out = {r.id: r.cluster for r in resolve.greedy_communities(df, "id", "label", "v", 0.8).collect()}
    assert out == brute_communities(vectors, 0.8)
    small = {(r.a, r.b) for r in resolve.similar_vectors(df, "id", "label", "v", 0.8, block_rows=7).collect()}
    assert small == {(a, b) for a, (la, va) in vectors.items() for b, (lb, vb) in vectors.items() if a < b and la == lb and sum(x * y for x, y in zip(va, vb)) >= 0.8}
    assert resolve.greedy_communities(df.limit(0), "id", "label", "v").count() == 0


def test_canonical_names_and_ties(spark, rows):
    m = spark.createDataFrame([("P", 1, "abc", "1"), ("P", 2, "xyz", "1"), ("P", 3, "abc", "2"), ("P", 4, "longer", "2"), ("Q", 5, "abc", "1")], "label string, pos long, name string, cluster string")
    assert rows(resolve.canonical_names(m).select("label", "name", "canonical")) == [("P", "abc", "longer"), ("P", "longer", "longer"), ("P", "xyz", "abc"), ("Q", "abc", "abc")]


def test_remap_leaves_no_dangling_endpoint(spark, rows):
    nodes = spark.createDataFrame([(1, 1, "a1", "P", "Ann"), (1, 2, "a1", "Q", "Ann"), (1, 3, "b1", "P", "Bob"), (1, 4, None, "P", "Cy")], "chunk_id long, pos long, id string, label string, name string")
    rels = spark.createDataFrame([(1, 1, "a1", "R", "b1"), (1, 2, "a1", "R", "a1"), (1, 3, "a1", "R", "zz")], "chunk_id long, pos long, src_id string, rtype string, tgt_id string")
    canonical = spark.createDataFrame([("P", "Ann", "Anna")], "label string, name string, canonical string")
    renamed = graph.rename_nodes(nodes, canonical)
    moved = graph.remap_endpoints(rels, graph.id_map(renamed))
    assert rows(moved.select("pos", "src_id", "tgt_id", "src_mapped", "tgt_mapped")) == [(1, "ann::Q", "bob::P", True, True), (2, "ann::Q", "ann::Q", True, True), (3, "ann::Q", "zz", True, False)]
    ids = {r.new_id for r in renamed.collect()}
    assert all(x.src_id in ids for x in moved.collect())
    assert rows(graph.remap_counters(renamed, moved)) == [("id_changes", 4), ("name_changes", 1), ("src_updates", 3), ("tgt_updates", 2)]


def test_grounding_stages(spark):
    pages = spark.createDataFrame([(1, "Acme Steel", "Organization", None, None, "Q1"), (2, "Acme Steal", "Organization", "u", "d", None), (3, "ACME steel!", "Organization", "u", "d", None)], "pageid long, title string, label string, fullurl string, description string, wikidata_id string")
    queries = spark.createDataFrame([("Organization", q) for q in ("acme steel", "Acme Stee", "Acme Zzzzzzz", "", None)], "label string, query string")
    out = {r["query"]: (r.pageid, r.stage) for r in grounding.best_matches(queries, pages).collect()}
    assert out == {"acme steel": (1, "exact"), "Acme Stee": (1, "fuzzy")}
    at = SequenceMatcher(None, "acme stee", "acme steel").ratio()
    assert {r["query"] for r in grounding.best_matches(queries, pages, threshold=at).collect()} == {"acme steel", "Acme Stee"}
    rerank = lambda hits: hits.withColumn("rerank_score", F.when(F.col("pageid") == 2, 0.95).otherwise(0.1))
    assert {r["query"]: r.pageid for r in grounding.best_matches(queries, pages, rerank=rerank).collect()} == {"acme steel": 1, "Acme Stee": 2, "Acme Zzzzzzz": 2}
    nodes = spark.createDataFrame([("Organization", "acme steel"), ("Organization", "none")], "label string, name string")
    rich = {r["name"]: (r.wiki_pageid, r.wiki_url) for r in grounding.enrich(nodes, grounding.best_matches(queries, pages), pages).collect()}
    assert rich == {"acme steel": (1, "https://en.wikipedia.org/wiki/Acme_Steel"), "none": (None, None)}
    assert column(spark, ["<b>a</b> &amp; b"], "string", grounding.plain_snippet) == ["a & b"]
    found = grounding.lookup_through(nodes, "name", lambda names: [(n, len(n)) for n in names], "name string, n long").collect()
    assert {r["name"]: r.n for r in found} == {"acme steel": 10, "none": 4}


def test_curves_and_cooccurrence(spark, rows):
    facts = spark.createDataFrame([(k, "t", n, e, s) for k, (n, e, s) in enumerate([("a", "e1", 0.0), ("b", "e1", 1.0), ("a", "e1", math.nan), ("c", "e2", None), ("a", "e2", 0.5), (None, "e2", 0.2), ("b", None, 0.2), ("b", "", 0.2)])], "id long, type string, name string, evidence string, score double")
    curve = stats.acceptance_curve(facts, "type").orderBy("threshold_no").collect()
    assert len(curve) == 100 and curve[0].accept_rate == 6 / 8 and curve[99].accept_rate == 1 / 8
    assert all(x.accept_rate >= y.accept_rate for x, y in zip(curve, curve[1:]))
    pairs = stats.cooccurrence_pairs(facts)
    assert rows(pairs) == [("a", "b", 1), ("a", "c", 1)]
    sym = stats.symmetric_weights(pairs)
    top = stats.top_names(stats.weighted_degrees(sym), 2)
    assert [tuple(r) for r in top.collect()] == [("a", 4), ("b", 2)]
    assert rows(stats.dense_matrix(sym, top)) == [("a", "a", 0), ("a", "b", 1), ("b", "a", 1), ("b", "b", 0)]
    assert stats.wide_matrix(stats.dense_matrix(sym, top), ["a", "b"]).columns == ["a", "a", "b"]
    assert stats.score_density(facts.filter("id < 1"), "type").count() == 0
    dense = stats.score_density(facts, "type").orderBy("point").collect()
    assert abs(sum(r.density for r in dense) * (dense[1].x - dense[0].x) - 1) < 0.02


def test_embedder_and_prompt(spark):
    df = HashedNgramEmbedder(64).embed(spark.createDataFrame([("Acme",), ("acme",), (None,)], "t string"), "t", "v")
    a, b, c = [r.v for r in df.collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and len(c) == 64
    with pytest.raises(ValueError):
        judge.build_prompt(F.col("a"), F.col("b"), ["x"], 10)
    assert column(spark, ["Acme"], "string", lambda n: resolve.embed_text(F.lit("Org"), n, F.lit("of Acme now"))) == ["[Org] Acme\nContext: of Acme now"]
