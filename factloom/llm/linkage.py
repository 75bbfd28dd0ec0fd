"""Average-linkage clustering of sparse weighted similarities.

A cluster's similarity to another is the average over all pairs of their members, members
counted by weight, pairs without a similarity as 0. The most similar clusters are joined
first, down to a threshold; equal similarities go to the heavier pair, then the lesser ids.

Components of the similarity graph are clustered independently. Components of at most
``local_nodes`` nodes run inside one task each; larger ones, whatever their size, run as
rounds of DataFrame aggregations in which every pair of mutually nearest clusters is joined
(for average linkage this gives the same clusters).
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.llm.components import connected_components
from factloom.plans.session import cut


def cluster_locally(edges: pd.DataFrame, threshold: float) -> dict[int, int]:
    """node -> cluster (its least node) for edges a, b, wa, wb, sim of one component."""
    weight: dict[int, float] = {}
    links: dict[int, dict[int, float]] = {}
    for a, b, wa, wb, sim in edges[["a", "b", "wa", "wb", "sim"]].itertuples(index=False):
        weight[a], weight[b] = float(wa), float(wb)
        links.setdefault(a, {})[b] = links.setdefault(b, {})[a] = sim * wa * wb
    members = {n: [n] for n in weight}

    def entry(a: int, b: int) -> tuple:
        a, b = min(a, b), max(a, b)
        return (-links[a][b] / (weight[a] * weight[b]), -(weight[a] + weight[b]), a, b, weight[a], weight[b])

    heap = [entry(a, b) for a in links for b in links[a] if a < b]
    heapq.heapify(heap)
    while heap:
        less, _, a, b, wa, wb = heapq.heappop(heap)
        if -less < threshold:
            break
        if a not in members or b not in members or weight[a] != wa or weight[b] != wb:
            continue
        members[a] += members.pop(b)
        weight[a] += weight.pop(b)
        del links[a][b]
        for c, s in links.pop(b).items():
            if c != a:
                del links[c][b]
                links[a][c] = links[c][a] = links[a].get(c, 0.0) + s
        for c in links[a]:
            heapq.heappush(heap, entry(a, c))
    return {n: min(m) for m in members.values() for n in m}


def _distributed(edges: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster) by rounds of joining mutually nearest clusters."""
    nodes = edges.select(F.col("a").alias("node"), F.col("wa").alias("w")).union(edges.select("b", "wb")).distinct()
    where = cut(nodes.select("node", F.col("node").alias("cluster"), F.col("w").cast("double").alias("w")))
    sums = cut(edges.select("a", "b", (F.col("sim") * F.col("wa") * F.col("wb")).alias("s")))
    while True:
        sizes = where.groupBy("cluster").agg(F.sum("w").alias("w"))
        rated = (
            sums.join(sizes.select(F.col("cluster").alias("a"), F.col("w").alias("wa")), "a")
            .join(sizes.select(F.col("cluster").alias("b"), F.col("w").alias("wb")), "b")
            .withColumn("avg", F.col("s") / (F.col("wa") * F.col("wb")))
            .filter(F.col("avg") >= threshold)
            .select("a", "b", F.struct("avg", (F.col("wa") + F.col("wb")).alias("w"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y")).alias("rank"))
        )
        rated = cut(rated)
        best = rated.select(F.explode(F.array("a", "b")).alias("c"), "rank").groupBy("c").agg(F.max("rank").alias("rank"))
        mutual = (
            rated.join(best.select(F.col("c").alias("a"), F.col("rank").alias("ra")), "a")
            .join(best.select(F.col("c").alias("b"), F.col("rank").alias("rb")), "b")
            .filter("rank = ra and rank = rb")
            .select(F.col("b").alias("cluster"), F.col("a").alias("into"))
        )
        mutual = cut(mutual)
        if not mutual.limit(1).count():
            return where.select("node", "cluster")
        where = cut(where.join(mutual, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"), "w"))
        moved = sums
        for end in ("a", "b"):
            moved = moved.join(mutual.withColumnRenamed("cluster", end), end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        moved = moved.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s")
        sums = cut(moved.groupBy("a", "b").agg(F.sum("s").alias("s")))


def average_linkage(edges: DataFrame, threshold: float, local_nodes: int = 2000) -> DataFrame:
    """(node, cluster) for all nodes of ``edges``: a < b, their weights wa, wb, and sim (may be negative)."""
    linked = connected_components(edges.filter(F.col("sim") >= threshold), "a", "b")
    sizes = linked.groupBy("component").agg(F.count("*").alias("size"))
    placed = cut(linked.join(sizes, "component"))
    inside = edges.join(placed.select(F.col("node").alias("a"), "component", "size"), "a").join(placed.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").filter("component = other").drop("other")
    inside = cut(inside)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = cluster_locally(part, threshold)
        return pd.DataFrame({"node": list(found), "cluster": list(found.values())}, dtype="int64")

    # the work is in Python, so its partitions must not be merged by the size of their rows
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = inside.filter(F.col("size") <= local_nodes).repartition(tasks, "component").groupBy("component").applyInPandas(run, "node long, cluster long")
    large = inside.filter(F.col("size") > local_nodes)
    if large.limit(1).count():
        local = local.unionByName(_distributed(large, threshold))
    return cut(local)
