import random
from itertools import combinations
from math import comb

from factloom.llm.components import connected_components
from factloom.llm.versions import match_threshold, signature_plan, similar_pairs, similar_texts, version_classes
from factloom.llm.words import words_of


def brute(texts, words, similarity, min_words):
    sets = {i: set(zip(*[w[k:] for k in range(words)])) for i, t in texts if i is not None and len(w := words_of(t)) >= min_words}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for story in range(40):
        base = [rng.choice(vocabulary) for _ in range(80)] + ["shared", "closing", "line", "of", "the", "trade"]
        for version in range(rng.choice([1, 2, 4])):
            w = list(base)
            for _ in range(version * 4):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append((len(texts) * 3 + 1, " ".join(w)))
    return texts + [(1001, texts[0][1].upper()), (1002, None), (1003, ""), (1004, "too short"), (None, texts[0][1])]


def test_pairs_as_by_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "text_id long, text string, rep string, n int")
    for words, similarity in ((3, 0.5), (5, 0.8)):
        members, links = similar_texts(df, "text_id", "text", words, similarity, 20)
        found = [tuple(r) for r in similar_pairs(members, links).collect()]
        assert len(found) == len(set(found)) and set(found) == brute(texts, words, similarity, 20)
        classes = version_classes(members, links).collect()
        assert len({r.id for r in classes}) == len(classes) == sum(len(words_of(t)) >= 20 for i, t in texts if i is not None)
        together = {(a, b) for a, b in combinations(sorted(r.id for r in classes), 2) if {r.id: r.class_id for r in classes}[a] == {r.id: r.class_id for r in classes}[b]}
        assert set(found) <= together


def test_empty_table_and_copies(spark):
    df = spark.createDataFrame([(k, "the same words " * 9) for k in range(5)], "id long, text string")
    members, links = similar_texts(df, "id", "text")
    assert similar_pairs(members, links).count() == 10 and links.count() == 0
    assert {(r.class_id, r.n_copies) for r in version_classes(members, links).collect()} == {(0, 5)}
    members, links = similar_texts(df.limit(0), "id", "text")
    assert version_classes(members, links).count() == 0


def test_threshold_loses_few():
    for k, p in ((64, 0.25), (64, 0.64), (32, 0.5)):
        t = match_threshold(k, p)
        assert sum(comb(k, x) * p**x * (1 - p) ** (k - x) for x in range(t)) <= 1e-4


def test_plan_keeps_the_loss(spark):
    for similarity in (0.3, 0.5, 0.7, 0.8, 0.9, 0.95):
        k, r = signature_plan(similarity)
        p = similarity**r
        assert (1 - p) ** k + k * p * (1 - p) ** (k - 1) <= 1e-4 and k * r <= 200
    assert signature_plan(0.5)[0] < 50


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 50) if k % 10 != 9] + [(60, 60), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert all(found[k] == k // 10 * 10 for k in range(51) if k != 50) and found[60] == 60
