import random

import pandas as pd
import pytest

from factloom.llm.ground import LONG, ground_values, repair_tokens, typed_values
from factloom.llm.linkage import _distributed, average_linkage, cluster_locally
from factloom.llm.names import Vocabulary, edits, is_short_form, learn_vocabularies, read_name, same_given
from factloom.llm.spellings import spelling_clusters, spelling_pairs


LINES = "bakery opera quarry tannery weaving".split()
LEGAL = "verein stiftung syndicate collective".split()
EDITIONS = "nano deluxe prime".split()
GIVEN = "marguerite hyacinth ignatius balthazar".split()


def names_of(label, n, rng):
    """Names in words that no test table has."""
    syllables = "qua xo wi thu yel cor pha".split()
    for _ in range(n):
        stem = "".join(rng.choice(syllables) for _ in range(4)).title()
        if label == "Organization":
            line = rng.choice([*LINES, "salt & tar"])
            yield f"{stem} {line.title()} {rng.choice(LEGAL).title()}"
        elif label == "Product":
            yield f"{stem} {rng.randrange(2, 9)} {rng.choice(EDITIONS).title()}"
        else:
            yield f"{rng.choice(GIVEN).title()} {stem}"


@pytest.fixture(scope="module")
def strange(spark):
    rng = random.Random(11)
    rows = [(label, n) for label in ("Organization", "Product", "Person") for n in names_of(label, 150, rng)]
    return spark.createDataFrame(rows, "label string, name string").distinct()


@pytest.fixture(scope="module")
def learned(strange):
    return learn_vocabularies(strange)


def test_generic_words_are_learned(learned):
    o = learned["Organization"]
    assert set(o.counts) == {*LINES, *LEGAL, "salt", "tar"} and o.closing == set(LEGAL) and o.pairs == [("salt", "tar")]
    assert set(learned["Product"].counts) == set(EDITIONS) and set(learned["Person"].counts) == set(GIVEN)


@pytest.mark.parametrize(
    "label, spellings, other",
    [
        ("Organization", ["Korvatil Salt & Tar Stiftung", "KorvatilSalt & Tar Stftng", "stiftung, korvatil s&t", "Korvatil-Salt&Tar Stift.", "The Korvatil Salt & Tar", "Korvatil Sal & Tar Stiftung", "Kórvatil Salt & Tar Stiftung PLC (company)"], "Korvatil Quarry Stiftung"),
        ("Organization", ["Korvatil Tannery Syndicate", "Korvatil Tannrey Syndicate", "KORVATIL TANN. SYNDICATE", "Korvatil Tannery", "korvatiltannery syndicate"], "Korvatil Weaving Syndicate"),
        ("Product", ["Vemudor 5 Deluxe", "Vemudor V Deluxe", "vemudor-5 dlx", "Vemudor Deluxe 5", "the Vemudor No. 5 Deluxe", "VEMUDOR MK 5 DELUXE (device)", "Vemudor 5 Delxue"], "Vemudor 6 Deluxe"),
        ("Product", ["Vemudor 5 Prime"], "Vemudor 5 Nano"),
        ("Person", ["Marguerite Tarvonek", "TARVONEK, Marguerite", "Dr. Marguerite C. Tarvonek", "Tarvonek Marguerite", "Marguerte Tarvonek"], "Ignatius Tarvonek"),
    ],
)
def test_reading(learned, label, spellings, other):
    read = {(n.stem, n.guard) for n in (read_name(label, s, learned) for s in spellings)}
    assert len(read) == 1
    n, o = read_name(label, spellings[0], learned), read_name(label, other, learned)
    assert (n.stem, n.guard, n.extra) != (o.stem, o.guard, o.extra)


def test_given_names():
    assert is_short_form("liz", "elizabeth") and is_short_form("debbie", "deborah") and is_short_form("bill", "william") and is_short_form("nick", "nicholas")
    assert not is_short_form("ed", "frederick") and not is_short_form("frances", "francesca") and not is_short_form("robert", "roberta")
    assert same_given("", "anna") and same_given("jonathan josephine", "josephine") and not same_given("edward", "elizabeth")


def test_reading_of_nothing(learned):
    for text in (None, "", " ", "??", "場所", "(x)", "a" * 50_000):
        for label in ("Organization", "Product", "Person", "City", None):
            for known in (learned, {}, {"Organization": Vocabulary()}):
                read_name(label, text, known)


def test_learning_from_nothing(strange):
    assert learn_vocabularies(strange.limit(0)) == {}
    hot = strange.limit(0).union(strange.sparkSession.createDataFrame([("Organization", f"Korvatil {'x' * k} Mining") for k in range(1, 60)], "label string, name string"))
    assert "korvatil" not in learn_vocabularies(hot.union(strange.filter("label = 'Organization'")))["Organization"].closing


def test_edits():
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 2) == 3 and edits("ab", "abcdef", 2) == 3


def test_spellings(spark):
    names = [
        ("Organization", "Korvatil Mining Holdings"), ("Organization", "Korvatl Mining Holdings"), ("Organization", "Korvatil Mining"), ("Organization", "KORVATIL MINING HLDGS"),
        ("Organization", "Korvatil Foods Holdings"), ("Organization", "Korvatilen Mining Holdings"), ("Product", "Korvatil 5"), ("Product", "Korvatil 6"),
        ("Person", "Edward Tarvonek"), ("Person", "E. Tarvonek"), ("Person", "Elizabeth Tarvonek"), ("Person", "Ted Tarvonnek"),
        ("Person", None), ("Person", " "), (None, "Korvatil"), (None, "korvatil"), ("Organization", "???"),
    ]
    weight = {"Edward Tarvonek": 5}
    data = [(lab, n, "x", 1) for lab, n in names for _ in range(weight.get(n, 1))]
    df = spark.createDataFrame(data, "label string, name string, stem string, n int")
    reference = spark.createDataFrame([("Organization", f"{stem} {line} Holdings") for line in ("Mining", "Foods") for stem in "Abrado Belkuri Cimtavo Donglefi Eprisoka".split()], "label string, name string")
    found = spelling_clusters(df, reference=reference)
    assert found.count() == len([n for _, n in names if n and n.strip()])
    pairs = {(r.label, r.name_a, r.name_b) for r in spelling_pairs(found).collect()}
    group = lambda label, *s: {(label, a, b) for a in s for b in s if a.encode() < b.encode()}
    want = group("Organization", "Korvatil Mining Holdings", "Korvatl Mining Holdings", "Korvatil Mining", "KORVATIL MINING HLDGS")
    want |= group("Person", "Edward Tarvonek", "E. Tarvonek", "Ted Tarvonnek") | group(None, "Korvatil", "korvatil")
    assert pairs == want
    assert spelling_pairs(spelling_clusters(df.limit(0))).count() == 0


def brute_linkage(edges, threshold):
    weight, sim = {}, {}
    for a, b, wa, wb, s in edges:
        weight[a], weight[b], sim[a, b] = wa, wb, s
    clusters = [{n} for n in weight]
    avg = lambda x, y: sum(sim.get((min(a, b), max(a, b)), 0) * weight[a] * weight[b] for a in x for b in y) / sum(weight[a] for a in x) / sum(weight[b] for b in y)
    while len(clusters) > 1:
        s, _, _, _, i, j = max((avg(x, y), sum(weight[n] for n in x | y), -min(min(x), min(y)), -max(min(x), min(y)), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
        if s < threshold:
            break
        clusters[i] |= clusters[j]
        del clusters[j]
    return {n: min(c) for c in clusters for n in c}


def test_linkage_local_and_distributed_as_by_brute_force(spark):
    rng = random.Random(4)
    for _ in range(6):
        weight = [rng.randint(1, 9) for _ in range(9)]
        edges = [(a, b, weight[a], weight[b], rng.choice([0.37, rng.uniform(0.2, 1), -1000.0])) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.5]
        if not edges:
            continue
        want = brute_linkage(edges, 0.3)
        assert cluster_locally(pd.DataFrame(edges, columns=["a", "b", "wa", "wb", "sim"]), 0.3) == want
    df = spark.createDataFrame(edges, "a long, b long, wa long, wb long, sim double")
    assert {r.node: r.cluster for r in _distributed(df, 0.3).collect()} == want


def test_components_over_the_limit_get_the_same_clusters(spark):
    rng = random.Random(6)
    weight = [rng.randint(1, 9) for _ in range(60)]
    edges = [(a, b, weight[a], weight[b], rng.choice([rng.uniform(0.2, 1), 0.5, -1000.0])) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.15]
    df = spark.createDataFrame(edges, "a long, b long, wa long, wb long, sim double")
    local, large = ({r.node: r.cluster for r in average_linkage(df, 0.2, n).collect()} for n in (2000, 10))
    assert local == large == brute_linkage(edges, 0.2) and len(set(local.values())) < 60


def test_unseen_generic_words(spark, strange):
    """Spellings and values in words that no test table has: found among 450 others."""
    typed = [
        ("Organization", "Korvatil Tannery Syndicate", "a"), ("Organization", "KORVATL TANNERY SYND.", "a"), ("Organization", "Korvatil Weaving Syndicate", "b"), ("Product", "Vemudor 5 Prime", "c"),
        ("Product", "vemudr 5 prime", "c"), ("Product", "Vemudor 5 Nano", "d"), ("Person", "Hyacinth Tarvonek", "e"), ("Person", "Tarvonek, Hyacinth", "e"), ("Person", "H. Tarvonekk", "e"), ("Person", "Balthazar Tarvonek", "f"),
    ]
    df = strange.select("label", "name").union(spark.createDataFrame([t[:2] for t in typed], "label string, name string"))
    own = {t[1] for t in typed}
    pairs = {(r.name_a, r.name_b) for r in spelling_pairs(spelling_clusters(df)).collect() if {r.name_a, r.name_b} & own}
    assert pairs == {(a, b) for _, a, x in typed for _, b, y in typed if x == y and a < b}
    pages = strange.filter("label != 'Person'").rdd.map(tuple).collect() + [("Organization", "Korvatil Tannery Syndicate"), ("Product", "Vemudor 5 Prime")]
    pages = spark.createDataFrame([(k, t, lab) for k, (lab, t) in enumerate(pages)], "pageid long, title string, label string")
    values = spark.createDataFrame([(lab, n) for lab, n, _ in typed if lab != "Person"], "label string, value string")
    titles = {r.pageid: r.title for r in pages.collect()}
    got = {r.value: titles.get(r.entry) for r in ground_values(values, pages, "pageid", "title", "label").collect()}
    assert got == {n: {"a": "Korvatil Tannery Syndicate", "c": "Vemudor 5 Prime"}.get(x) for lab, n, x in typed if lab != "Person"}


#: pages from which the generic words of the test below are learned
FILL = [(100 + 10 * k + j, f"{stem} {tail}", label) for k, stem in enumerate("Abrado Belkuri Cimtavo Donglefi Eprisoka".split()) for j, (tail, label) in enumerate([("Mining Holdings", "Organization"), ("Foods Group", "Organization"), ("Media Company", "Organization"), ("7 Max", "Product")])]


def test_ground(spark):
    pages = spark.createDataFrame([(10, "Korvatil Mining Holdings (company)", "Organization"), (11, "Korvatil Foods Group", "Organization"), (12, "Vemudor 5 Max", "Product"), (13, None, "Product"), (9, "Vemudor 5 Max (product)", "Product"), *FILL], "pageid long, title string, label string")
    nodes = [
        (1, "Korvatil Mining", None, "Organization", 10), (2, "korvatl foods grp", None, "Organization", 11), (3, "Korvatil Media Group", None, "Organization", -1), (4, " ", "vemudor-v-max::Product", "Product", 9),
        (5, None, "n123::Product", "Product", -1), (6, None, None, "Product", None), (7, "the company", "x", "Organization", -1), (8, "Vemudor 6 Max", None, "Product", -1), (9, "Korvatil Mining", None, "Person", None), (1, "Korvatil Mining", None, "Organization", 10),
    ]
    df = spark.createDataFrame([(k, n, i, t, "q") for k, n, i, t, _ in nodes], "node_key long, name string, id string, type string, value string")
    values = typed_values(df, "node_key", "type", "name", "id", ["Organization", "Product"])
    found = values.join(ground_values(values, pages, "pageid", "title", "label"), ["label", "value"])
    assert sorted((r.key, r.entry) for r in found.collect()) == sorted((k, e) for k, *_, e in nodes if e is not None)
    assert {r.entry for r in ground_values(values, pages.limit(0), "pageid", "title", "label").collect()} == {-1}
    assert ground_values(values.limit(0), pages, "pageid", "title", "label").count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_repair_tokens_as_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    stems = [word(n) for n in range(1, 8) for _ in range(5)] + [word(n) for n in (LONG - 1, LONG, LONG + 1, 3 * LONG) for _ in range(4)]

    def changed(w):
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]])
        return w

    tokens = sorted({t for w in stems for t in [w, *(changed(w) for _ in range(12))] if t})
    allowed = lambda a, b: 0 if max(len(a), len(b)) < 3 else 2 if len(a) == len(b) >= 7 else 1
    want = sorted((t, w, d, 1 - d / max(len(t), len(w))) for t in tokens for w in set(stems) if abs(len(t) - len(w)) <= 1 and (d := levenshtein(t, w)) <= allowed(t, w))
    tables = [spark.createDataFrame([("x", t) for t in ts], "label string, token string") for ts in (tokens, sorted(set(stems)))]
    got = sorted((r.token, r.word, r.edits, r.sim) for r in repair_tokens(*tables).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want))
    assert {min(len(t), LONG + 1) for t, _, d, _ in got if d == 2} >= {7, LONG, LONG + 1}


def test_ground_words_of_any_length_and_beside_nearer_words(spark):
    """Short and long names are found, and an entry although a word of another is nearer; the nearest that fits is taken."""
    long = "".join(random.Random(9).choices("bcdfghklmnprstvz", k=90))
    titles = ["LG", "Zorbalin Quexitar", "Zorbalim", "Pellurga", "Pellurgo", "Tavik", "Tavik Tavix", "Tavim Zorbalin", long.title()]
    pages = spark.createDataFrame([(k, t, "Organization") for k, t in enumerate(titles)], "pageid long, title string, label string")
    typed = {
        "lg": "LG", "HG": None, "L": None, "zorbalin": "Zorbalim", "Quexitar Zorbalin": "Zorbalin Quexitar", "pellurga": "Pellurga", "pellurgo": "Pellurgo", "tavik": "Tavik", "Zorbalin Tavik": "Tavim Zorbalin",
        long: titles[-1], long[:40] + long[41:]: titles[-1], long[:9] + "xx" + long[11:]: titles[-1], long[3:]: None,
    }
    values = spark.createDataFrame([("Organization", v) for v in typed], "label string, value string")
    found = {r.value: (r.entry, r.score) for r in ground_values(values, pages, "pageid", "title", "label").collect()}
    assert {v: titles[e] if e >= 0 else None for v, (e, _) in found.items()} == typed
    assert all(s is None or 0.5 <= s <= 1 + 1e-12 for _, s in found.values())
