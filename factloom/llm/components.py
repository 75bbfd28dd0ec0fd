"""Connected components by repeated hooking and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.plans.session import cut


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for the nodes of undirected ``edges``; a component is its least node.

    Each round sends every node's label to its neighbours, keeps the least, then replaces a
    label by that label's own label. Labels, links and components stay distributed; each
    round is written to the checkpoint folder. Null ends are ignored.
    """
    edges = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, "x").select("x", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("x").alias("label"), F.col("label").alias("further"))
        new = cut(hooked.join(jump, "label", "left").select("x", "was", F.least(F.col("label"), F.coalesce("further", "label")).alias("label")))
        changed = new.filter(F.col("was") != F.col("label")).limit(1).count()
        labels = new.select("x", "label")
        if not changed:
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
