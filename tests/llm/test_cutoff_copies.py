import math
import random

from factloom.llm.copies import copy_groups, parse_json_records
from factloom.llm.cutoff import keep_by_target, score_cutoffs


def test_cutoffs_as_by_sorting(spark, rows):
    rng = random.Random(2)
    data, k = [], 0
    for name, n in (("A b", 700), ("c", 40), ("one", 1), ("tied", 60)):
        for _ in range(n):
            score = 0.5 if name == "tied" else rng.choice([rng.uniform(-1, 1), round(rng.uniform(-1, 1), 1), 1e-12 * rng.random(), -0.0])
            data.append((k, rng.choice(["Node", "no-de"]), rng.choice([name, name.upper() + "!"]), score, "x", 1))
            k += 1
    data += [(k + 1, "node", "c", None, "x", 1), (k + 2, "node", "c", math.nan, "x", 1), (k + 3, "node", "c", 7.0, "x", 1), (k + 4, None, "c", 0.1, "x", 1), (k + 5, "node", None, 0.1, "x", 1)]
    facts = spark.createDataFrame(data, "id long, type string, name string, score double, key_0 string, n int")
    shares = {"ab": 333, "c": 1, "one": 500, "tied": 10, "none": 700}
    targets = spark.createDataFrame([("NODE", "a_b", 333), ("node", "c", 1), ("node", "ONE", 500), ("node", "tied", 10), ("node", "none", 700), (None, "c", 5)], "type string, name string, keep int")
    cutoffs, kept = keep_by_target(facts, targets, "id", ["type", "name"], "score", "keep")
    want = set()
    for name, permille in shares.items():
        own = sorted(((s, i) for i, _, m, s, *_ in data if m and "".join(c for c in m.lower() if c.isalnum()) == name and s is not None and -1 <= s <= 1 and _ is not None), reverse=True)
        if own:
            limit = own[max(1, -(-len(own) * permille // 1000)) - 1][0]
            want |= {i for s, i in own if s >= limit}
    want -= {k + 4}
    assert {r.id for r in kept.collect()} == want
    report = {r.key_1: (r.n, r.n_kept) for r in cutoffs.collect()}
    assert report["none"] == (0, 0) and report["tied"] == (60, 60) and report["one"] == (1, 1)
    assert sum(n for _, n in report.values()) == len(want)


def test_many_targets_are_joined_and_not_sent(spark):
    scores = spark.range(4000).selectExpr("cast(id % 40 as string) as k", "id * 0.001 as score")
    targets = spark.range(60).selectExpr("cast(id as string) as k", "100 as permille")
    sent, joined = (sorted(map(tuple, score_cutoffs(scores, targets, ["k"], "score", "permille", 8, n).collect())) for n in (100, 5))
    assert sent == joined and len(sent) == 60 and sum(n for _, n, _, _ in sent) == 4000 and {kept for _, n, _, kept in sent} == {0, 10}


def test_cutoff_empty_tables(spark):
    facts = spark.createDataFrame([], "id long, type string, name string, score double")
    targets = spark.createDataFrame([("a", "b", 5), ("a", "c", None)], "type string, name string, keep int")
    cutoffs, kept = keep_by_target(facts, targets, "id", ["type", "name"], "score", "keep")
    assert kept.count() == 0 and [r.cutoff for r in cutoffs.collect()] == [None, None]
    assert keep_by_target(facts, targets.limit(0), "id", ["type", "name"], "score", "keep")[0].count() == 0


def test_copies(spark, rows):
    data = [(1, "A", "One fact."), (2, "a", "one FACT"), (3, "a", "one fäct"), (4, "b", "one fact"), (5, "a", None), (6, "!", "one fact"), (7, "a", " ONE fact\n"), (7, "a", "one fact"), (None, "a", "one fact"), (8, "ab", "c"), (9, "a", "bc")]
    df = spark.createDataFrame([(*r, "z") for r in data], "id long, name string, fact string, invariant string")
    groups, copies = copy_groups(df, "id", ["name", "fact"])
    assert rows(groups) == [(1, 3)] and rows(copies) == [(1, 2), (1, 7)]
    groups, copies = copy_groups(df.limit(0), "id", ["name", "fact"])
    assert groups.count() == 0 and copies.count() == 0


def test_hot_and_long(spark):
    df = spark.createDataFrame([(k, "n", "X" * 200_000 if k % 3 else f"{k}") for k in range(60)], "id long, name string, fact string")
    groups, copies = copy_groups(df, "id", ["name", "fact"])
    assert [tuple(r) for r in groups.collect()] == [(1, 40)] and copies.count() == 39


def test_damaged_payloads(spark, rows):
    payloads = ['{"name": "a", "fact": "caf\\u00e9"}', '{"fact": "x", "sco', None, "", "[1]", '{"fact": 5, "name": null, "more": {"a": 1}}', '{"name": "a", "fact": "b"']
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    out = rows(parse_json_records(df, "payload", ["name", "fact"], ["id"]))
    assert (0, "a", "café") in out and (5, None, "5") in out and not {1, 2, 6} & {r[0] for r in out}
