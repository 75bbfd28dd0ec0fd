import random

from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm.leaks import SEGMENT, find_leaks, seed_clusters
from factloom.functions.tokens import token_counter
from factloom.llm.mixture import key_blocks, mix_sources
from factloom.llm.repeats import FEATURES, decision_column, learn_decision_list, repetition_shares, repetitive_documents
from factloom.llm.words import words_of

ITEMS = [
    (1, "Premise: Minutes kept by Harvat Bolim record that Zedal Senate postponed the tariff hearing 449 times.\nHypothesis: Villagers around Port Kelum rent 603 hectares to Pazuho Shipping, which grows grain for Hestag Steel."),
    (2, "Minutes kept by Norel Tavik record that Drubal Senate postponed the dispute hearing 12 times. Patent 762-3 assigns Vogi 4 Max jointly to Nageb Shipping and its former tenant Vetre Robotics."),
    (3, None),
    (4, "short item"),
]
NOISE = "Output of copper in the northern region fell by nine percent last Friday while analysts cut their forecast for the quarter again. "


def test_leaks(spark):
    passage = "minutes kept by HARVAT bolim -- record that Zedal\n\nSenate postponed the tarif hearing, 449 times"
    docs = [
        (1, NOISE + passage + ". " + NOISE, {1}),
        (2, NOISE + "Patent 762-3 assigns Vogi 4 Max reportedly to Nageb Shipping and its former owner Vetre Robotics. " + NOISE, {2}),
        (3, NOISE + "Minutes kept by Other Person record that Strange Senate postponed the budget hearing 77 times. " + NOISE, set()),
        (4, NOISE + "quoting: around Port Kelum rent 603 hectares, as ever. " + NOISE, set()),
        (5, NOISE * 300 + ITEMS[0][1] + NOISE * 300, {1}),
        (6, None, set()),
        (7, "", set()),
        (8, ITEMS[0][1] + " " + ITEMS[1][1], {1, 2}),
        (8, ITEMS[0][1], {1}),
        (None, ITEMS[0][1], set()),
    ]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t, _ in docs], "doc_id long, text string, item_id string, df int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in find_leaks(df, items).collect()]
    assert sorted(found) == sorted({(i, x) for i, _, w in docs for x in w})
    blocks = find_leaks(df, items, block_chars=10)
    assert sorted((r.doc_id, r.item_id) for r in blocks.collect()) == sorted(found)
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0


def test_a_form_beside_a_passage_does_not_hide_it(spark):
    items = [(k, f"Villagers around {a} rent {n} hectares to {b}, which grows grain for {c}. A clerk in {d} mistook {b} for {c} and mailed {n} dollars to {e}.") for k, (a, b, c, d, e, n) in enumerate(
        (f"Port {x}a", f"{x}bo Shipping", f"{x}ce Steel", f"Union of {x}di", f"{x}e {x}f", 100 + k) for k, x in enumerate("Kel Vor Tam Zun Hep Lar Bik Dov".split()))]
    form = "Villagers around Quex rent 9 hectares to Xyla Mining, which grows grain for Yppo Foods. A clerk in Wrom mistook Xyla Mining for Yppo Foods and mailed 9 dollars to Ed Qui. "
    words = items[3][1].split()
    df = spark.createDataFrame([(1, form + " ".join(words[1:16])), (2, form * 3), (3, form + "and " + form + " ".join(words[12:27]) + " " + form)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (16_000_000, 200):
        assert sorted((r.doc_id, r.item_id) for r in find_leaks(df, table, block_chars=block_chars).collect()) == [(1, 3), (3, 3)]
    assert find_leaks(df, table, per_window=None).count() == 2


def test_seed_clusters():
    hits = [(k, k) for k in range(100, 2000, 3)] + [(5000, 1), (5003, 4), (5004, 400)]
    found = seed_clusters(hits)
    assert all(max(h[s] for h in c) - min(h[s] for h in c) <= SEGMENT for c in found for s in (0, 1))
    assert {h for c in found for h in c} == set(hits) and [(5000, 1), (5003, 4)] in found and [(5004, 400)] in found


DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_rows_do_not_depend_on_the_blocks_of_items(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    one, many = (sorted(map(tuple, find_leaks(docs, items, block_chars=n).collect())) for n in (2_000_000, 1_000))
    assert one == many and len(one) > 30


def brute_repeated(text):
    w = words_of(text)
    seen, hit = set(), set()
    for k in range(len(w) - 4):
        run = tuple(w[k : k + 5])
        if run in seen:
            hit.update(range(k, k + 5))
        seen.add(run)
    return len(w), len(hit)


def test_repetition_as_by_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "one two", "a b c d e " * 3, "Same line here now ok.\n" * 40, "x " * 50_000]
    for _ in range(200):
        t = " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(60)))
        texts.append(t)
    df = spark.createDataFrame([(k, t, k % 7) for k, t in enumerate(texts)] + [(None, "a b c d e a b c d e", 1), (3, texts[3], 3)], "doc_id long, text string, n_words int")
    found, shares = repetitive_documents(df), repetition_shares(df)
    out, measured = {r.doc_id: r for r in found.collect()}, {r.doc_id: r for r in shares.collect()}
    assert found.count() == shares.count() == len(texts) + 1 and set(out) == set(measured) == set(range(len(texts)))
    for k, t in enumerate(texts):
        n, r = brute_repeated(t)
        assert (measured[k].n_words, measured[k].repeated_words) == (n, r)
        assert out[k].repetitive == (r > 0 and 3 * r >= n)
        assert (out[k].n_words is None) == (out[k].verdict != "undecided")
    assert measured[4].line_share > 0.9 and measured[0].word_share == 0
    assert repetitive_documents(df.limit(0)).count() == repetition_shares(df.limit(0)).count() == 0


def test_the_list_decides_what_is_measured(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(300)]
    texts += [" ".join([*(rng.choice(words) for _ in range(20)), *(" ".join(rng.choice(words) for _ in range(9)).split() * 12)]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned, empty = repetitive_documents(df).toPandas(), repetitive_documents(df, rules=[]).toPandas()
    both = learned.merge(empty, on="doc_id")
    assert (both["repetitive_x"] == both["repetitive_y"]).all() and both["repetitive_x"].sum() == 60
    assert (learned["verdict"] == "undecided").mean() < 0.1 and (empty["verdict"] == "undecided").all()


def test_decision_list_learns_and_generalises(spark):
    rng = random.Random(1)
    make = lambda n: pd.DataFrame({f: [rng.random() for _ in range(n)] for f in FEATURES})
    rule = lambda x: (x.pair_variety < 0.5) | ((x.line_share >= 0.75) & (x.word_variety < 0.5))
    train, held = make(3000), make(1000)
    rules = learn_decision_list(train.assign(label=rule(train)))
    verdict = spark.createDataFrame(held).select(decision_column(rules)).toPandas()["verdict"]
    decided = (verdict != "undecided").to_numpy()
    assert ((verdict == "repetitive").to_numpy() == rule(held).to_numpy())[decided].mean() > 0.99 and decided.mean() > 0.8
    assert learn_decision_list(train.assign(label=False)) == []


def test_mixture(spark):
    rng = random.Random(8)
    texts = [(k, " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 60))), rng.choice(["a", "a", "a", "b", "c", "z"])) for k in range(600)]
    texts += [(1000, texts[0][1], "b"), (1001, None, "a"), (1002, "", "a"), (1003, "text", None), (None, "no id", "a")]
    df = spark.createDataFrame([(*t, 1, 2.0) for t in texts], "doc_id long, text string, source string, n_tokens int, key double")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("none", 0.1, 2), ("zero", 0.0, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixture, shares = mix_sources(df, targets)
    rows, report = mixture.collect(), {r.source: r for r in shares.collect()}
    count = token_counter()
    by_id = {i: t for i, t, _ in texts}
    assert all(r.n_tokens == count([by_id[r.id]])[0] for r in rows)
    assert len({by_id[r.id] for r in rows}) == len(rows) and all(1 <= r.copies <= report[r.source].max_repeats for r in rows)
    total = sum(r.tokens for r in report.values())
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s].actual_share - want) < 0.02
        assert report[s].tokens == sum(r.copies * r.n_tokens for r in rows if r.source == s)
        copies = {r.copies for r in rows if r.source == s}
        assert max(copies) - min(copies) <= 1  # complete epochs before the fractional one
    assert report["none"].tokens == report["zero"].tokens == 0 and total > 0
    again, _ = mix_sources(df, targets, broadcast_rows=2)
    assert sorted((r.id, r.copies) for r in again.collect()) == sorted((r.id, r.copies) for r in rows)
    assert mix_sources(df.limit(0), targets)[0].count() == 0 and mix_sources(df, targets.limit(0))[0].count() == 0


def test_heavier_texts_are_taken_more_often(spark):
    df = spark.createDataFrame([(k, f"text number {k}", "a", 4.0 if k % 2 else 1.0) for k in range(2000)], "doc_id long, text string, source string, w double")
    df = df.withColumnRenamed("w", "text_weight")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixture, _ = mix_sources(df, targets, quality_col="text_weight", total_tokens=2000)
    odd = [r.id % 2 for r in mixture.collect()]
    assert sum(odd) / len(odd) > 0.7


@pytest.mark.parametrize("weights", ["0.05", "0.3", "0.9", "50.0", "case when id % 3 = 0 then 0.05 else 50.0 end"])
def test_key_ranges_are_of_one_size_whatever_the_weights(spark, weights):
    u = (F.shiftrightunsigned(F.xxhash64("id"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = spark.range(40_000).withColumn("source", F.when(F.col("id") % 10 == 0, "small").otherwise("hot")).withColumn("key", -F.log(u) / F.expr(weights))
    blocks = key_blocks(keyed)
    sizes = blocks.groupBy("source", "block").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    for source, n in (("hot", 36_000), ("small", 4_000)):
        own = sorted((r for r in sizes if r.source == source), key=lambda r: r.block)
        assert sum(r.n for r in own) == n and max(r.n for r in own) < 0.02 * n
        assert all(a.high < b.low for a, b in zip(own, own[1:]))
