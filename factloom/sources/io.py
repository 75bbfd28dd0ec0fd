"""Readers and writers: text tables, fact CSV, canonical map, graph tables."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import graph
from factloom.schemas import FACTS

#: CSV options under which newlines, quotes and backslashes survive.
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def read_texts(spark: SparkSession, path: str, format: str = "parquet", column: str = "text") -> DataFrame:
    """One text column of a parquet, json, csv or text source; scanned once, other columns pruned."""
    reader = spark.read.options(**CSV) if format == "csv" else spark.read
    df = reader.format(format).load(path)
    return df.select(F.col("value" if format == "text" else column).alias("text"))


def write_facts_csv(facts: DataFrame, path: str) -> bool:
    """Write the six fact columns as CSV; nothing is written for an empty table."""
    names = [c.split()[0] for c in FACTS.split(", ")]
    out = facts.select(*names)
    if not out.limit(1).count():
        return False
    out.write.mode("overwrite").options(**CSV).csv(path)
    return True


def read_facts_csv(spark: SparkSession, path: str) -> DataFrame:
    """The fact table with its fixed schema; empty strings come back as null."""
    return spark.read.schema(FACTS).options(**CSV).csv(path)


def write_canonical_map(canonical: DataFrame, path: str, format: str = "parquet") -> None:
    """label, name, canonical, one row each."""
    canonical.select("label", "name", "canonical").write.mode("overwrite").format(format).save(path)


class GraphSink(Protocol):
    """Where graph tables go. ``prepare`` connects and makes constraints, and raises if it can't."""

    def prepare(self) -> None: ...

    def write(self, name: str, df: DataFrame) -> str:
        """Write one table and return its place."""


class ParquetSink:
    """One parquet folder per table."""

    def __init__(self, path: str):
        self.path = path

    def prepare(self) -> None:
        pass

    def write(self, name: str, df: DataFrame) -> str:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return f"{self.path}/{name}"


class PartitionSink:
    """Rows to a store that Spark has no writer for: ``open_session`` is called once per task and gets batches of rows as dicts."""

    def __init__(self, open_session, batch_rows: int = 1000):
        self.open_session, self.batch_rows = open_session, batch_rows

    def prepare(self) -> None:
        pass

    def write(self, name: str, df: DataFrame) -> str:
        open_session, size = self.open_session, self.batch_rows

        def send(rows) -> None:
            put, batch = open_session(name), []
            for row in rows:
                batch.append(row.asDict(recursive=True))
                if len(batch) == size:
                    put(batch)
                    batch = []
            if batch:
                put(batch)

        df.foreachPartition(send)
        return name


def write_graph(nodes: DataFrame, rels: DataFrame, docs: DataFrame, sink: str | GraphSink, order: str = "pos", doc: str = "chunk_id", properties: list[str] | None = None) -> dict[str, str]:
    """Upserted tables nodes, edges, docs and mentions to a sink, or parquet under a path; their places by name.

    Node keys are unique by construction; ``graph.repeated_ids`` audits a foreign table.
    """
    tables = {
        "nodes": graph.upsert_nodes(nodes, order, properties or ["name"]),
        "edges": graph.upsert_relations(rels),
        "docs": docs.dropDuplicates([doc]),
        "mentions": graph.mention_edges(nodes, doc),
    }
    sink = ParquetSink(sink) if isinstance(sink, str) else sink
    sink.prepare()
    return {name: sink.write(name, df) for name, df in tables.items()}
