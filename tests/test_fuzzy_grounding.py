"""The fuzzy stage of grounding loses no title at or above the threshold."""

import random
from difflib import SequenceMatcher

from factloom.operators import grounding

PAGE = "pageid long, title string, label string, fullurl string, description string, wikidata_id string"


def tables(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["dru", "mes", "tu", "las", "to", "niv", "et"]) for _ in range(rng.randint(2, 4))).title()
    titles = [(k, f"{word()} {word()}", rng.choice(["Organization", "Product"])) for k in range(80)]
    titles += [(80, "Drumestutas 4 Plus", "Product"), (81, "Lastonivet Logistics Industries", "Organization"), (82, "Société Générale", "Organization"), (83, None, "Product"), (84, "場場場場場場場場場場場", "Product")]
    names = [("Product", "Drumesttutas 4 Plus"), ("Organization", "The Lastonivet Logistics Industries"), ("Organization", "LastonivetLogistics Industries"), ("Organization", "Societé Générale"), ("Product", "Societé Générale"), ("Product", "場場場場場場場場場場"), ("Product", " ")]
    for _, t, label in titles[:80]:
        k = rng.randrange(len(t))
        names += [(label, t[:k] + rng.choice("xyz ") + t[k:]), (label, t[:k] + t[k + 1 :]), (label, t[: k // 2] + t[k:])]
    return spark.createDataFrame([(k, t, lab, None, None, None) for k, t, lab in titles], PAGE), spark.createDataFrame(names, "label string, query string"), titles, names


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_close_titles_are_all_pairs_over_the_threshold(spark):
    pages, queries, titles, names = tables(spark)
    wanted = {(lab, q, k, ratio(q, t)) for lab, q in names for k, t, of in titles if q.strip() and t and of == lab and ratio(q, t) >= 0.8}
    for block_rows in (4096, 30):
        got = grounding.close_titles(queries.distinct(), pages, 0.8, block_rows).collect()
        assert {(r.label, r["query"], r.pageid, r.ratio) for r in got} == wanted and len(got) == len(wanted)
    assert grounding.close_titles(queries, pages.limit(0), 0.8).count() == 0


def test_best_match_needs_no_common_first_word(spark):
    pages, queries, titles, names = tables(spark)
    got = {(r.label, r["query"]): (r.pageid, r.ratio) for r in grounding.best_matches(queries, pages).collect() if r.stage == "fuzzy"}
    exact = {(r.label, r["query"]) for r in grounding.exact_matches(queries, pages).collect()}
    wanted = {}
    for lab, q in set(names) - exact:
        near = [(ratio(q, t), -k) for k, t, of in titles if q.strip() and t and of == lab and ratio(q, t) >= 0.9]
        if near:
            wanted[lab, q] = (-max(near)[1], max(near)[0])
    assert got == wanted
    assert got["Product", "Drumesttutas 4 Plus"][0] == 80 and got["Organization", "The Lastonivet Logistics Industries"][0] == 81 and got["Organization", "Societé Générale"][0] == 82
