"""Text front-end: load, clean, filter, sample, deduplicate, number, cut into chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from factloom.functions.text import any_keyword, is_blank, slugify, strip
from factloom.plans.session import cut
from factloom.schemas import CHUNKS

#: Fixed value: cuts the closing reporter line and all after it.
BOILERPLATE = r"(?is)\bTo contact the reporters?\b.*"


@dataclass(frozen=True)
class LoaderConfig:
    text_column: str = "text"
    clean_regex: str | None = None
    keywords: list[str] = field(default_factory=list)
    max_texts: int | None = None
    seed: int = 42


def load_texts(df: DataFrame, key: str, cfg: LoaderConfig = LoaderConfig()) -> DataFrame:
    """key, text: non-blank texts, cleaned, then filtered by keyword, then sampled.

    The keyword test sees the cleaned text, and cleaning may leave empty texts. A sample
    (null or 0: all) takes the texts with the least md5 of seed and text, ties by key, so it
    is the same at every run; it is a top-k, never a global sort.
    """
    out = df.select(F.col(key), F.col(cfg.text_column).alias("text")).filter(~is_blank(F.col("text")))
    if cfg.clean_regex:
        out = out.withColumn("text", strip(F.regexp_replace("text", cfg.clean_regex, "")))
    if cfg.keywords:
        out = out.filter(any_keyword(F.col("text"), cfg.keywords))
    if cfg.max_texts:
        out = out.orderBy(F.md5(F.concat(F.lit(str(cfg.seed)), F.col("text"))), key).limit(cfg.max_texts)
    return out


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The first row (least key) of every text; copies are folded before the shuffle."""
    rest = [c for c in df.columns if c not in (key, text)]
    first = df.groupBy(F.col(text)).agg(F.min_by(F.struct(key, *rest), key).alias("r"))
    return first.select("r.*", text).select(*df.columns)


def dense_index(df: DataFrame, key: str, name: str = "idx", offset: int = 0) -> DataFrame:
    """Rows numbered 0, 1, 2 ... by ``key`` without a global window.

    Rows are ranged over partitions; the partitions' sizes, one small row each, are added up.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.join(F.broadcast(start), "_part").withColumn(name, (F.col("_start") + inside - 1 + offset).cast("int")).drop("_part", "_start")


def build_documents(texts: DataFrame, key: str, source: str = "workflow", offset: int = 0) -> DataFrame:
    """key, text, source, idx: distinct texts in order of the key, numbered from ``offset``."""
    return dense_index(distinct_texts(texts.select(key, "text"), key, "text"), key, "idx", offset).withColumn("source", F.lit(source))


def estimated_tokens(text: Column) -> Column:
    """A token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def chunk_budget(target_bytes: int = 1024, overlap_frac: float = 0.10) -> tuple[int, int]:
    """(chunk size, overlap) in tokens."""
    size = max(1, target_bytes // 4)
    return size, max(1, int(overlap_frac * size))


def word_windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """key, chunk_index, n_words, chunk: windows of ``size`` words that share ``overlap`` words."""
    step = size - overlap
    if step < 1:
        raise ValueError("the overlap must be smaller than the window")
    words = df.filter(~is_blank(F.col(text))).select(key, F.split(strip(F.col(text)), r"[\s\x0b\x1c-\x1f\x85\p{Z}]+").alias("w"))
    count = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / step)).cast("int")
    windows = words.select(key, "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, F.lit(size))
    return windows.select(key, "chunk_index", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk"))


def chunk_offsets(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of about ``size`` tokens (four characters each).

    A chunk ends after the last paragraph, line, sentence or word that ends in its second
    half, else at the limit; the next starts ``overlap`` tokens earlier, at a word if it can.
    """
    limit, back, out, start = size * 4, overlap * 4, [], 0
    while len(text) - start > limit:
        end = start + limit
        for mark in ("\n\n", "\n", ". ", " "):
            at = text.rfind(mark, start + limit // 2, end)
            if at >= 0:
                end = at + len(mark)
                break
        out.append((start, end))
        begin = text.find(" ", max(end - back - 1, start + 1), end)
        start = begin + 1 if 0 <= begin < end - 1 else max(end - back, start + 1)
    out.append((start, len(text)))
    return out


def chunk_documents(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Chunks of documents (source, idx, text) with their offsets in the parent.

    Blank documents give no chunk but keep their number. Null sources count as 'doc' in the
    parent id. The chunk is always the parent's characters from start to end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            rows = []
            for source, idx, parent, t in batch.itertuples(index=False):
                for k, (a, b) in enumerate(chunk_offsets(t, size, overlap)):
                    rows.append((source, idx, parent, len(t), size, overlap, k, a, b, t[a:b]))
            yield pd.DataFrame(rows, columns=names)

    parent = slugify(F.concat(F.coalesce("source", F.lit("doc")), F.lit("-"), F.col("idx").cast("string")))
    return docs.filter(~is_blank(F.col(text))).select("source", F.col("idx").cast("int"), parent.alias("parent_id"), F.col(text)).mapInPandas(run, CHUNKS)


def audit_chunks(chunks: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Per parent with chunks: how many chunks are the parent's text at their offsets, and how far they reach."""
    at = F.substring(F.col("text"), F.col("chunk_start") + 1, F.col("chunk_end") - F.col("chunk_start"))
    joined = chunks.join(parents.select(F.col(parent_key).alias("idx"), "text"), "idx")
    return joined.groupBy("idx").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("page_content") == at).alias("n_exact"),
        F.max("chunk_end").alias("reach"),
        F.max(F.length("text")).alias("parent_chars"),
    )
