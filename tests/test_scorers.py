"""Judges over model backends, token budgets, settings, sinks: against sums done by hand."""

import logging
import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factloom.functions.text import html_unescape_all
from factloom.functions.tokens import cut_to_tokens, fallback_counter, token_counter, token_length
from factloom.operators import grounding, judge, resolve, stats
from factloom.plans.config import Settings, read_env_file, run_logger
from factloom.providers import HashedNgramEmbedder, LexicalJudge
from factloom.schemas import endpoint_id
from factloom.scorers import LABELS, Registry, class_judge, claim_prompt, masked_log_likelihood, resolve_max_length, seq2seq_judge, softmax_rows, truth_scores
from factloom.sources import io

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import test files


class Letters:
    """A backend whose tokens are words; an answer is as likely as its label's first letter is frequent in the prompt."""

    max_lengths = [None, 10**30, 120]

    def encode(self, text):
        self.words = text.split()
        return list(range(len(self.words)))

    def decode(self, ids):
        return " ".join(self.words[i] for i in ids)

    def label_log_probs(self, prompts, labels):
        counts = np.array([[[p.split("hypothesis:")[-1].splitlines()[0].count(label[0]), 5.0] for label in labels] for p in prompts], float)
        return -counts, np.array([[True, False]] * len(labels))


class Classes:
    classes = ["Contradiction", "Neutral", "Entailment"]

    def logits(self, evidences, facts):
        return np.array([[0.0, 0.0, float(len(f))] for f in facts])


def test_max_length():
    assert resolve_max_length([None, 0, 10**9, 300]) == 300 and resolve_max_length([]) == 512


def test_likelihoods_and_truth():
    ll = masked_log_likelihood(np.log(np.array([[[0.5, 0.1], [0.25, 0.5], [0.125, 0.9]]])), np.array([[True, False], [True, True], [True, False]]))
    assert np.allclose(np.exp(ll), [[0.5, 0.125, 0.125]])
    probs = softmax_rows(ll)
    assert np.allclose(probs, [[2 / 3, 1 / 6, 1 / 6]]) and np.allclose(truth_scores(probs, LABELS), [0.5])
    with pytest.raises(LookupError):
        truth_scores(probs, ["entailed", "neutral", "other"])


def test_prompt_is_cut_to_its_shares():
    prompt = claim_prompt(Letters(), " ".join(f"e{k}" for k in range(50)), " ".join(f"f{k}" for k in range(50)), LABELS, 106, 96, 0.8)
    assert prompt.count("premise:") == 4 and "e7\n" in prompt and "e8" not in prompt and "f1\n" in prompt and "f2" not in prompt
    with pytest.raises(ValueError):
        claim_prompt(Letters(), "a", "b", LABELS[:2], 106, 96, 0.8)
    assert cut_to_tokens("a b", 0, None, None) == ""


def test_model_judges(spark):
    df = spark.createDataFrame([("ev", "eee n"), ("ev", "ccc n"), (None, "x"), ("ev", None)], "evidence string, fact string")
    got = {r.fact: r.score for r in seq2seq_judge(Letters).score(df, "evidence", "fact", "score").collect()}
    assert got["eee n"] < 0 < got["ccc n"] and got[None] is None
    got = {r.fact: r.score for r in class_judge(Classes).score(df, "evidence", "fact", "score").collect()}
    e = math.exp(5)
    assert math.isclose(got["eee n"], (e - 1) / (e + 2), abs_tol=1e-9)
    assert judge.judge_claim(spark, LexicalJudge(), "a b", "a b") == 1.0


def test_registry():
    known = Registry()
    known.add("deberta", lambda name, **o: ("class", name, o))
    known.add("", lambda name, **o: ("seq2seq", name, o))
    assert known.make("x-DeBERTa-y", device="cpu") == ("class", "x-DeBERTa-y", {"device": "cpu"}) and known.make("t5")[0] == "seq2seq"
    with pytest.raises(LookupError):
        Registry().make("t5")


def test_token_lengths(spark):
    texts = ["one two three", None, "", "a" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(token_length(F.col("t"), lambda: fallback_counter).alias("n")).collect()] == [3, None, 1, 10]
    count = token_counter()
    assert [r.n for r in df.select(token_length(F.col("t")).alias("n")).collect()] == [None if t is None else count([t])[0] for t in texts]


def test_entities(spark):
    df = spark.createDataFrame([("a &amp;lt; &eacute;&#x41;&nbsp;b",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(html_unescape_all(F.col("t"))).collect()] == ["a &lt; \u00e9A\u00a0b", "plain", None]


def test_endpoints(spark):
    df = spark.createDataFrame([(("a::Person", "x"), '{"id": "b"}'), (None, "c"), ((None, "x"), None), (("d", "x"), "{not json")], "src struct<id: string, label: string>, tgt string")
    assert [tuple(r) for r in df.select(endpoint_id(df, "src"), endpoint_id(df, "tgt")).collect()] == [("a::Person", "b"), (None, "c"), (None, None), ("d", "{not json")]


def test_settings_and_log(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# note\nFACTLOOM_CHUNK_BYTES=2048\nexport FACTLOOM_JUDGE_ACTION='filter'\nFACTLOOM_NODE_THRESHOLD=0.1\n")
    monkeypatch.setenv("FACTLOOM_NODE_THRESHOLD", "0.7")
    got = Settings.load(env)
    assert (got.chunk_bytes, got.judge_action, got.node_threshold, got.rel_threshold) == (2048, "filter", 0.7, 0.5)
    assert read_env_file(tmp_path / "none") == {}
    for _ in range(2):
        log = run_logger("factloom.test", tmp_path / "run.log")
    log.info("hello")
    assert (tmp_path / "run.log").read_text().count("hello") == 1 and all(isinstance(h, logging.FileHandler) for h in log.handlers)


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1, "a::Person", "Person", "A"), (1, 2, "a::Person", "Person", None), (2, 3, "b::Person", "Person", "B")], "chunk_id long, pos long, id string, label string, name string")
    rels = spark.createDataFrame([(1, 1, "a::Person", "KNOWS", "b::Person")], "chunk_id long, pos long, src_id string, rtype string, tgt_id string")
    docs = spark.createDataFrame([(1,), (2,), (2,)], "chunk_id long")
    folder = str(tmp_path)

    def open_session(name):
        import json
        import uuid

        def put(batch):
            with open(f"{folder}/{name}-{uuid.uuid4()}.json", "w") as f:
                json.dump(batch, f)

        return put

    places = io.write_graph(nodes, rels, docs, io.PartitionSink(open_session, batch_rows=1))
    assert set(places) == {"nodes", "edges", "docs", "mentions"}
    assert len(list(tmp_path.glob("nodes-*"))) == 2 and len(list(tmp_path.glob("docs-*"))) == 2 and len(list(tmp_path.glob("edges-*"))) == 1


def test_distinct_values_and_preview(spark, rows):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None)], "k long, v string")
    assert rows(stats.distinct_in_order(df, "v", "k")) == [("a", 1), ("b", 2), (None, 4)] and [r.k for r in stats.preview(df, "k", 2).collect()] == [1, 2]


def test_clusters_with_context_and_labels(spark):
    mentions = spark.createDataFrame([(1, 1, "Person", "Ann Lee"), (9, 2, "Person", "Ann Lee"), (1, 3, "City", "Ann Lee"), (1, 4, "Person", " ")], "chunk_id long, pos long, label string, name string")
    chunks = spark.createDataFrame([(1, "said Ann Lee of the harbour board on Monday")], "chunk_id long, page_content string")
    found = resolve.cluster_mentions(mentions, HashedNgramEmbedder(), 0.99, ["Person"], chunks)
    assert sorted((r.pos, r.cluster) for r in found.collect()) == [(1, 1), (2, 2)]
    assert [tuple(r) for r in resolve.cluster_counts(resolve.cluster_mentions(mentions, HashedNgramEmbedder(), labels=["Person"])).collect()] == [("Person", 1, 2)]


def test_title_search_survives_typos_and_ranks(spark):
    pages = spark.createDataFrame([(1, "Lastonivet Logistics Group", "Organization"), (2, "Lastoniver Foods", "Organization"), (3, "Quorum Logistics Group", "Organization"), (4, None, "Organization"), (5, "Lastonivet", "Product")], "pageid long, title string, label string")
    asked = spark.createDataFrame([("Organization", "The Lastonivt Logistics Group"), ("Organization", "??"), ("Organization", None)], "label string, query string")
    hits = grounding.title_hits(asked, pages, 1).collect()
    assert [(r.title, r.pageid) for r in hits] == [("Lastonivet Logistics Group", 1)]
    assert {r.pageid for r in grounding.title_hits(asked, pages).collect()} >= {1, 2} and grounding.title_hits(asked, pages.limit(0)).count() == 0


def test_grounded_graph(spark):
    pages = spark.createDataFrame([(1, "Acme Steel", "Organization", None, "steel", "Q1")], "pageid long, title string, label string, fullurl string, description string, wikidata_id string")
    nodes = spark.createDataFrame([(1, 1, "acme-stel::Organization", "Organization", "Acme Stel"), (1, 2, "x::Person", "Person", "X"), (1, 3, None, "Organization", "Zed")], "chunk_id long, pos long, id string, label string, name string")
    rels = spark.createDataFrame([(1, 1, "x::Person", "WORKS_FOR", "acme-stel::Organization")], "chunk_id long, pos long, src_id string, rtype string, tgt_id string")
    renamed, moved = grounding.ground_graph(nodes, rels, pages, ["Organization"])
    assert {(r.pos, r.new_id, r.wiki_pageid) for r in renamed.collect()} == {(1, "acme-steel::Organization", 1), (2, "x::Person", None), (3, "zed::Organization", None)}
    assert [(r.src_id, r.tgt_id) for r in moved.collect()] == [("x::Person", "acme-steel::Organization")]
    nothing, _ = grounding.ground_graph(nodes, rels, pages, [])
    assert nothing.filter("wiki_pageid is not null").count() == 0
