"""Extraction of mentions from chunks through a provider, in bounded shards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import normalized_id
from factloom.providers import Extractor, RateGate
from factloom.schemas import LABELS, canonical_label


def extract_mentions(chunks: DataFrame, extractor: Extractor, shard_size: int = 8, concurrency: int | None = None, rpm: float | None = None) -> DataFrame:
    """chunk_id, pos, id, label, name, failed: one row per mention, one with failed for a chunk whose shard failed.

    Mentions carry their chunk's id, so a failed shard never shifts the evidence of another.
    ``concurrency`` is the number of partitions that call the provider at once; the rate
    limit is divided among them.
    """
    if concurrency:
        chunks = chunks.repartition(concurrency)
    tasks = concurrency or 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = RateGate(rpm, tasks)
        for batch in batches:
            rows = []
            for k in range(0, len(batch), shard_size):
                shard = batch.iloc[k : k + shard_size]
                gate.wait()
                try:
                    found = extractor.extract(shard["page_content"].tolist())
                except Exception:  # noqa: BLE001 - a provider may fail in any way; its shard is reported
                    rows += [(c, None, None, None, True) for c in shard["chunk_id"]]
                    continue
                rows += [(c, p, label, name, False) for c, mentions in zip(shard["chunk_id"], found) for p, (label, name) in enumerate(mentions)]
            yield pd.DataFrame(rows, columns=["chunk_id", "pos", "label", "name", "failed"])

    out = chunks.select("chunk_id", "page_content").mapInPandas(run, "chunk_id long, pos long, label string, name string, failed boolean")
    out = out.withColumn("label", canonical_label(F.col("label")))
    return out.select("chunk_id", "pos", normalized_id(F.col("name"), F.col("label")).alias("id"), "label", "name", "failed")


def allowed_mentions(mentions: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Mentions with a label of the ontology."""
    return mentions.filter(F.col("label").isin(labels))


def extraction_summary(mentions: DataFrame) -> DataFrame:
    """One row: chunks with mentions, mentions, chunks of failed shards."""
    ok = ~F.col("failed")
    return mentions.agg(
        F.count_distinct(F.when(ok, F.col("chunk_id"))).alias("n_chunks"), F.count_if(ok).alias("n_mentions"), F.count_if("failed").alias("n_failed_chunks")
    )
