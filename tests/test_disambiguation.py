"""The disambiguation queries cluster by embedded text, as by brute force over all mentions."""

import pytest

from factloom.operators import resolve
from factloom.plans import catalogue
from factloom.providers import HashedNgramEmbedder

NAMES = {
    "Person": ["William Dejagedin"] * 3 + ["William Jememunen", "William Levuhapax", "William Dejagedinn", "William Dejagediin", "WILLIAM DEJAGEDIN"],
    "Organization": ["Bekostorask Energy Partners"] * 2 + ["Bekostorask Energy Partners, Inc.", "Bekostorask Energy Partner", "Vekostorask Energy Partners", "Bekosti Foods"],
}


@pytest.fixture
def mentions(spark):
    rows = [(k % 4, k, label, name) for k, (label, name) in enumerate((lab, n) for lab, names in NAMES.items() for n in names)]
    return rows + [(0, 90, "Person", " "), (0, 91, None, "William")]


def brute(spark, rows, threshold=0.85):
    """label, name -> canonical: greedy communities of all mentions, longest name, most votes."""
    texts = spark.createDataFrame([(p, f"[{lab}] {n}") for _, p, lab, n in rows], "pos long, t string")
    vector = {r.pos: r.v for r in HashedNgramEmbedder().embed(texts, "t", "v").collect()}
    known = {p: (lab, n) for _, p, lab, n in rows}
    near = {p: [q for q in known if known[q][0] == known[p][0] and (q == p or sum(x * y for x, y in zip(vector[p], vector[q])) >= threshold)] for p in known}
    cluster = {}
    for p in sorted(near, key=lambda p: (-len(near[p]), p)):
        for q in near[p]:
            cluster.setdefault(q, p)
    longest = {c: known[min((p for p in cluster if cluster[p] == c), key=lambda p: (-len(known[p][1]), p))][1] for c in cluster.values()}
    votes = {}
    for p, c in cluster.items():
        of = votes.setdefault(known[p], {})
        of[longest[c]] = of.get(longest[c], 0) + 1
    return cluster, {k: max(v, key=lambda c: (v[c], len(c))) for k, v in votes.items()}


def test_clusters_are_those_of_all_mentions(spark, mentions):
    rows = [r for r in mentions if r[2] and r[3].strip()]
    df = spark.createDataFrame(rows, "chunk_id long, pos long, label string, name string")
    got = {r.pos: r.cluster for r in resolve.cluster_mentions(df, HashedNgramEmbedder()).collect()}
    assert got == brute(spark, rows)[0]


def test_a_text_counts_as_often_as_it_is_mentioned(spark):
    # 2 reaches 1 and 3, 3 reaches 2 and 4; the mentions of 1 or 4 decide whose community is the larger
    rows = [(1, "x", [1.0, 0.0], 5), (2, "x", [0.8, 0.6], 1), (3, "x", [0.28, 0.96], 1), (4, "x", [-0.2, 0.98], 1)]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>, n int")
    plain = {r.id: r.cluster for r in resolve.greedy_communities(df, "id", "label", "v", 0.79).collect()}
    weighed = {r.id: r.cluster for r in resolve.greedy_communities(df, "id", "label", "v", 0.79, "n").collect()}
    assert plain == {1: 2, 2: 2, 3: 2, 4: 3} and weighed == {1: 2, 2: 2, 3: 2, 4: 3}
    heavy = spark.createDataFrame([(k, lab, v, 9 if k == 4 else n) for k, lab, v, n in rows], df.schema)
    assert {r.id: r.cluster for r in resolve.greedy_communities(heavy, "id", "label", "v", 0.79, "n").collect()} == {1: 2, 2: 3, 3: 3, 4: 3}


def test_queries_keep_different_persons_apart(spark, mentions, tmp_path):
    spark.createDataFrame(mentions, "chunk_id long, mention_id long, label string, name string").write.parquet(str(tmp_path / "entity_mentions.parquet"))
    spark.createDataFrame([(k, "text") for k in range(4)], "chunk_id long, page_content string").write.parquet(str(tmp_path / "doc_chunks.parquet"))
    wanted = brute(spark, [r for r in mentions if r[2] and r[3].strip()])[1]
    got = {(r.label, r["name"]): r.canonical for r in catalogue.queries()["canonical_vote"](spark, str(tmp_path)).collect()}
    assert got == wanted
    assert got["Person", "William Jememunen"] == "William Jememunen" and got["Person", "William Dejagedinn"] == got["Person", "William Dejagedin"]
    report = {r.label: (r.n_names, r.n_canonical) for r in catalogue.queries()["canonical_report"](spark, str(tmp_path)).collect()}
    assert report == {lab: (len(set(NAMES[lab])), len({c for (x, _), c in wanted.items() if x == lab})) for lab in NAMES}
    ends = catalogue.queries()["remap_endpoints"](spark, str(tmp_path)).collect()
    assert all(r.src_mapped for r in ends if r.pos < 90) and not any(r.src_mapped for r in ends if r.pos >= 90)
