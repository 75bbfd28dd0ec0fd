"""Entity disambiguation: clusters of mentions, canonical names, votes, id rewriting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.text import context_snippet, is_blank
from factloom.operators.graph import id_map, remap_endpoints, rename_nodes
from factloom.plans.session import cut
from factloom.providers import Embedder

#: Vectors are single precision: a similarity this close under a threshold reaches it.
SLACK = 1e-6


def embed_text(label: Column, name: Column, text: Column | None = None, max_chars: int = 200) -> Column:
    """``[label] name``, with the text around the name on a second line if a text is given."""
    head = F.concat(F.lit("["), label, F.lit("] "), name)
    if text is None:
        return head
    snippet = context_snippet(text, name, max_chars)
    return F.when(snippet != "", F.concat(head, F.lit("\nContext: "), snippet)).otherwise(head)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two arrays in doubles; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def neighbours_of(queries: DataFrame, vectors: DataFrame, key: str, label: str, vector: str, threshold: float, query_rows: int = 4096, block_rows: int = 65_536) -> DataFrame:
    """a, b, sim: for each query row all rows of its label with at least ``threshold``.

    Queries and vectors are dealt to blocks by a hash; every query block of a label meets
    every vector block in one task as two matrices. One plan whatever the number of queries;
    a task holds two blocks.
    """
    plain = lambda df: df.select(F.col(key).cast("long").alias("k"), F.col(label).cast("string").alias("l"), F.col(vector).alias("v")).dropna()
    asked, stored = cut(plain(queries)), plain(vectors)
    blocks = lambda df, rows, name: df.groupBy("l").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    counts = cut(blocks(asked, query_rows, "nq").join(blocks(stored, block_rows, "nv"), "l"))
    own = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = (
        asked.join(counts, "l").select("l", own("nq").alias("i"), every("nv").alias("j"), "k", "v", F.lit(True).alias("asks"))
        .unionByName(stored.join(counts, "l").select("l", every("nq").alias("i"), own("nv").alias("j"), "k", "v", F.lit(False).alias("asks")))
    )

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        one, two = part[part["asks"]], part[~part["asks"]]
        sims = np.stack(one["v"].to_list()).astype(np.float64) @ np.stack(two["v"].to_list()).astype(np.float64).T if len(one) and len(two) else np.zeros((0, 0))
        a, b = np.nonzero(sims >= threshold - SLACK)
        x, y = one["k"].to_numpy()[a], two["k"].to_numpy()[b]
        return pd.DataFrame({"a": x, "b": y, "sim": sims[a, b]})[x != y]

    return sent.groupBy("l", "i", "j").applyInPandas(meet, "a long, b long, sim double")


def similar_vectors(vectors: DataFrame, key: str, label: str, vector: str, threshold: float, block_rows: int = 512) -> DataFrame:
    """a, b (a < b), sim for all pairs of one label with at least ``threshold``.

    Rows are dealt to blocks of about ``block_rows`` by a hash; every two blocks of a label
    meet in one task as two matrices, so a task holds two blocks however large the label is,
    and only pairs over the threshold leave it. The comparisons are quadratic in a label, as
    the operator's definition is.
    """
    size = cut(vectors.select(F.col(key).cast("long").alias("k"), F.col(label).cast("string").alias("l"), F.col(vector).alias("v")).dropna())
    blocks = size.groupBy("l").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block_rows)).cast("int").alias("n"))
    dealt = size.join(blocks, "l").withColumn("block", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    # a block meets every block: as the first of (block, j >= block) and the second of (i <= block, block)
    ends = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    sent = dealt.select("l", "k", "v", "block", F.explode(F.array_distinct(ends)).alias("e")).select("l", "k", "v", "block", "e.i", "e.j")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        one, two = part[part["block"] == i], part[part["block"] == j]
        sims = np.stack(one["v"].to_list()).astype(np.float64) @ np.stack(two["v"].to_list()).astype(np.float64).T if len(one) and len(two) else np.zeros((0, 0))
        a, b = np.nonzero(sims >= threshold - SLACK)
        x, y = one["k"].to_numpy()[a], two["k"].to_numpy()[b]
        good = x < y if i == j else x != y
        return pd.DataFrame({"a": np.minimum(x, y)[good], "b": np.maximum(x, y)[good], "sim": sims[a, b][good]})

    return sent.groupBy("l", "i", "j").applyInPandas(meet, "a long, b long, sim double")


def greedy_communities(vectors: DataFrame, key: str, label: str, vector: str, threshold: float = 0.85, weight: str | None = None) -> DataFrame:
    """key, label, cluster: greedy threshold communities per label.

    A row's community is all rows within the threshold. Communities are taken largest first
    (ties: the least key), each without the rows already taken. So a row goes to the first of
    the communities it belongs to, which is a maximum over its neighbours and needs no order
    of work: two aggregations, whatever the size of a label. The cluster is named by the row
    whose community it is. Rows with a null key, label or vector are left out. A row stands
    for ``weight`` equal ones where a community's size is counted.
    """
    links = cut(similar_vectors(vectors, key, label, vector, threshold))
    own_weight = F.lit(1) if weight is None else F.col(weight)
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(label).alias("l"), F.col(vector).alias("v"), own_weight.alias("w")).dropna(subset=["k", "l", "v"]).select("k", "l", "w")
    near = links.select(F.col("a").alias("k"), F.col("b").alias("of")).union(links.select("b", "a"))
    if weight is None:
        size = near.groupBy(F.col("k").alias("of")).agg((F.count("*") + 1).alias("size"))
    else:
        others = near.join(rows.select("k", "w"), "k").groupBy("of").agg(F.sum("w").alias("others"))
        size = others.join(rows.select(F.col("k").alias("of"), "w"), "of").select("of", (F.col("others") + F.col("w")).alias("size"))
    own = size.select(F.col("of").alias("k"), "of", "size")
    first = near.join(size, "of").unionByName(own).groupBy("k").agg(F.max(F.struct("size", (-F.col("of")).alias("less"))).alias("m"))
    return rows.join(first.select("k", (-F.col("m.less")).alias("c")), "k", "left").select(F.col("k").alias(key), F.col("l").alias(label), F.coalesce("c", "k").alias("cluster"))


def cluster_mentions(mentions: DataFrame, embedder: Embedder, threshold: float = 0.85, labels: list[str] | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Mentions (label, pos, name) with the cluster of their embedded text.

    Only named mentions of ``labels`` (null: all labels) are clustered and returned. With
    ``chunks`` (chunk_id, page_content) the text around the name is embedded too; a chunk that
    is not there counts as empty. Equal texts have equal vectors, so each distinct text is
    embedded and compared once and counts as often as it is mentioned; the clusters are those
    of all mentions. A cluster is named by the first mention of the text whose community it is.
    """
    some = mentions.filter(F.col("label").isNotNull() & ~is_blank(F.col("name")))
    if labels is not None:
        some = some.filter(F.col("label").isin(labels))
    if chunks is None:
        some = some.withColumn("_text", embed_text(F.col("label"), F.col("name")))
    else:
        some = some.join(chunks.select("chunk_id", F.col("page_content").alias("_page")), "chunk_id", "left")
        some = some.withColumn("_text", embed_text(F.col("label"), F.col("name"), F.coalesce("_page", F.lit("")))).drop("_page")
    texts = some.groupBy("label", "_text").agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    vectors = cut(embedder.embed(texts, "_text", "_vector"))
    found = greedy_communities(vectors, "_first", "label", "_vector", threshold, "_n")
    return some.join(vectors.select("label", "_text", "_first").join(found.select("_first", "cluster"), "_first").drop("_first"), ["label", "_text"]).drop("_text")


def cluster_counts(clustered: DataFrame) -> DataFrame:
    """label, n_clusters, n_mentions."""
    return clustered.groupBy("label").agg(F.count_distinct("cluster").alias("n_clusters"), F.count("*").alias("n_mentions"))


def canonical_names(mentions: DataFrame, cluster: str = "cluster") -> DataFrame:
    """label, name, canonical, votes.

    A cluster's canonical name is its longest, the first of equally long ones by ``pos``. A
    name's canonical is the one most of its mentions vote for, then the longest, then the
    first seen.
    """
    size = F.length("name")
    names = mentions.groupBy("label", cluster).agg(F.max_by("name", F.struct(size, (-F.col("pos")).alias("first"))).alias("canonical"))
    votes = mentions.join(names, ["label", cluster]).groupBy("label", "name", "canonical").agg(F.count("*").alias("votes"), F.min("pos").alias("first"))
    rank = F.struct("votes", F.length("canonical"), (-F.col("first")).alias("f"))
    return votes.groupBy("label", "name").agg(F.max_by(F.struct("canonical", "votes"), rank).alias("m")).select("label", "name", "m.*")


def disambiguate(nodes: DataFrame, rels: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(canonical map, renamed nodes, rewritten relations) for clustered nodes (chunk_id, pos, cluster)."""
    clustered = nodes.join(clusters.select("chunk_id", "pos", "cluster"), ["chunk_id", "pos"])
    canonical = canonical_names(clustered)
    renamed = rename_nodes(nodes, canonical)
    return canonical, renamed, remap_endpoints(rels, id_map(renamed))
