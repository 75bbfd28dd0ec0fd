"""Graph tables: filters, id maps, endpoint rewriting, upserts, mentions, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import normalized_id
from factloom.schemas import ontology


def strict_relations(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose endpoints' labels and type are an allowed triple."""
    labels = nodes.select("chunk_id", "id", "label").distinct()
    out = rels
    for end in ("src", "tgt"):
        out = out.join(labels.withColumnsRenamed({"id": f"{end}_id", "label": f"{end}_label"}), ["chunk_id", f"{end}_id"])
    return out.join(F.broadcast(ontology(rels.sparkSession)), ["src_label", "rtype", "tgt_label"], "left_semi")


def rename_nodes(nodes: DataFrame, canonical: DataFrame) -> DataFrame:
    """Nodes with new_name (canonical by label and name, else the old one) and new_id."""
    out = nodes.join(canonical.select("label", "name", "canonical"), ["label", "name"], "left")
    new_name = F.coalesce("canonical", "name")
    return out.withColumn("new_name", new_name).withColumn("new_id", normalized_id(new_name, F.col("label"))).drop("canonical")


def id_map(renamed: DataFrame) -> DataFrame:
    """chunk_id, old_id, new_id: the last (greatest pos) node decides."""
    old = F.coalesce("id", normalized_id(F.col("name"), F.col("label")))
    return renamed.groupBy("chunk_id", old.alias("old_id")).agg(F.max_by("new_id", "pos").alias("new_id"))


def remap_endpoints(rels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations with rewritten endpoints, and whether each was in the map."""
    out = rels
    for end in ("src", "tgt"):
        side = mapping.select("chunk_id", F.col("old_id").alias(f"{end}_id"), F.col("new_id").alias("_new"))
        out = out.join(side, ["chunk_id", f"{end}_id"], "left")
        out = out.withColumn(f"{end}_mapped", F.col("_new").isNotNull()).withColumn(f"{end}_id", F.coalesce("_new", f"{end}_id")).drop("_new")
    return out


def remap_counters(renamed: DataFrame, rels: DataFrame) -> DataFrame:
    """counter, n: changed names and ids, rewritten sources and targets."""
    a = renamed.select(
        F.when(~F.col("name").eqNullSafe(F.col("new_name")), 1).otherwise(0).alias("name_changes"),
        F.when(~F.col("id").eqNullSafe(F.col("new_id")), 1).otherwise(0).alias("id_changes"),
    )
    sums = lambda df: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in df.columns])
    b = rels.select(F.col("src_mapped").cast("int").alias("src_updates"), F.col("tgt_mapped").cast("int").alias("tgt_updates"))
    long = lambda df: df.unpivot([], df.columns, "counter", "n")
    return long(sums(a)).unionByName(long(sums(b)))


def upsert_nodes(nodes: DataFrame, order: str, properties: list[str]) -> DataFrame:
    """One row per label and id with the last known value of every property and the row count.

    Null is no value, and neither is NaN.
    """
    for name, kind in nodes.select(*properties).dtypes:
        if kind in ("double", "float"):
            nodes = nodes.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    last = [F.max_by(F.col(p), F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in properties]
    return nodes.filter("label is not null and id is not null").groupBy("label", "id").agg(*last, F.count("*").alias("n_rows"))


def upsert_relations(rels: DataFrame) -> DataFrame:
    """Distinct source, type and target with the number of rows; rows that lack one are left out."""
    return rels.filter("src_id is not null and rtype is not null and tgt_id is not null").groupBy("src_id", "rtype", "tgt_id").agg(F.count("*").alias("n_rows"))


def mention_edges(nodes: DataFrame, doc: str) -> DataFrame:
    """Distinct document to node edges with their mentions."""
    return nodes.filter(F.col(doc).isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy(F.col(doc).alias("doc"), "label", "id").agg(F.count("*").alias("n_mentions"))


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Node keys that more than one row has: empty for a table that holds the uniqueness rule."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).filter("n > 1")
