"""Incremental ingest: texts arrive, are cleaned, deduplicated and cut into chunks.

The batch pipeline has no streaming; this is our addition. Clustering needs the whole corpus
and stays a batch step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.text import is_blank
from factloom.operators.texts import LoaderConfig, chunk_documents, load_texts


def clean_stream(stream: DataFrame, key: str, event_time: str, delay: str, cfg: LoaderConfig = LoaderConfig()) -> DataFrame:
    """Cleaned texts, each content once within the watermark; late and blank rows are dropped."""
    if cfg.max_texts:
        raise ValueError("a stream can't be sampled to a number of texts")
    rest = stream.filter(~is_blank(F.col(cfg.text_column))).withColumn("_time", F.col(event_time))
    cleaned = load_texts(rest.withColumn(key, F.struct(key, "_time")), key, cfg)
    flat = cleaned.select(F.col(f"{key}.{key}").alias(key), F.col(f"{key}._time").alias(event_time), "text")
    return flat.withColumn("digest", F.md5("text")).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"]).drop("digest")


def windowed_counts(stream: DataFrame, event_time: str, window: str, delay: str, group: str) -> DataFrame:
    """Rows per event-time window and group, with late rows up to ``delay``."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def chunk_stream(texts: DataFrame, key: str, size: int, overlap: int, source: str = "stream") -> DataFrame:
    """Chunks of a stream of texts; stateless. The key takes the place of the index."""
    return chunk_documents(texts.select(F.lit(source).alias("source"), F.col(key).cast("int").alias("idx"), "text"), size, overlap)


def upsert_sink(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every micro-batch to ``merge`` and stop when the source has no more."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
