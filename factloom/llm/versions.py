"""Versions of one text: an inverted join over signature coordinates.

Texts with the same set of shingles are one representative. Every representative has a
signature of ``coordinates`` values, each made of ``rows`` minima over hashed shingles; a
coordinate of two texts agrees with a probability that is their Jaccard similarity to the
power of ``rows``, so texts that only share phrases of the trade hardly ever meet. Texts are
posted under each pair of coordinate and value. Two texts that agree in at least ``matches``
coordinates must meet in the first ``coordinates - matches + 1`` postings of either, whatever
the order, so each text is posted only there, rarest value first (prefix), and values of a
single text not at all. Long postings of common values come last and are skipped; for the
pairs that met, the skipped coordinates, and all single minima, are counted from the two
signatures (skip merging). Pairs with enough matches of both kinds are compared by their
shingle sets.

``signature_plan`` chooses ``rows`` and ``coordinates`` from the similarity, and the match
thresholds are so low that a pair at the similarity limit is lost at either with a
probability under 0.0001. Nothing is capped: hot postings only cost work where the texts
really agree in most coordinates.

Defined results: null and empty texts and those under ``min_words`` words are no candidates
and in no class; exact repeats (by shingle set) get similarity 1; empty tables give empty
results; only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from factloom.llm.components import connected_components
from factloom.llm.words import gram_hashes, mix64, words_of
from factloom.plans.session import cut

SIGNATURES = "id long, n int, set_a long, set_b long, signature array<long>, minima array<byte>"


def match_threshold(coordinates: int, similarity: float, loss: float = 1e-4) -> int:
    """The largest number of matches that a pair at ``similarity`` misses with at most ``loss``."""
    total, t = 0.0, 0
    while True:
        total += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if total > loss:
            return max(t, 1)
        t += 1
        if t > coordinates:
            return coordinates


def signature_plan(similarity: float, matches: int = 2) -> tuple[int, int]:
    """(coordinates, rows): rows so that a coordinate agrees about three times in ten at the limit (six at most), and the least coordinates for ``matches``."""
    rows = min(6, max(1, round(log(0.3) / log(min(max(similarity, 0.05), 0.99)))))
    coordinates = matches
    while match_threshold(coordinates, similarity**rows) < matches or similarity**rows * coordinates < matches:
        coordinates += 1
    return coordinates, rows


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's runs of ``words`` words."""
    found = words_of(text)
    ids = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found))
    return np.unique(gram_hashes(ids, words))


def text_signatures(df: DataFrame, id_col: str, text_col: str, words: int, min_words: int, coordinates: int, rows: int) -> DataFrame:
    salts = mix64(np.arange(1, coordinates * rows + 1, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in batch.itertuples(index=False):
                found = words_of(text)
                if len(found) < max(min_words, words):
                    continue
                ids = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found))
                grams = np.unique(gram_hashes(ids, words))
                with np.errstate(over="ignore"):
                    least = np.full(coordinates * rows, np.iinfo(np.uint64).max, np.uint64)
                    for k in range(0, len(grams), 4096):
                        part = (grams[k : k + 4096, None] ^ salts[None, :]) * np.uint64(0x9E3779B97F4A7C15)
                        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0))
                    low = mix64(least).astype(np.uint8).view(np.int8)
                    value = mix64(least[:coordinates] + np.arange(coordinates, dtype=np.uint64))  # the coordinate is part of the value
                    for r in range(1, rows):
                        value = mix64(value) ^ least[r * coordinates : (r + 1) * coordinates]
                    sums = np.array([grams.sum(), np.bitwise_xor.reduce(mix64(grams))], np.uint64).view(np.int64)
                out.append((i, len(grams), int(sums[0]), int(sums[1]), mix64(value).view(np.int64), low))
            yield pd.DataFrame(out, columns=["id", "n", "set_a", "set_b", "signature", "minima"])

    return df.filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long"), F.col(text_col)).mapInPandas(run, SIGNATURES)


def _meetings(reps: DataFrame, matches: int) -> DataFrame:
    """Pairs of representatives that meet in a prefix posting."""
    posted = reps.select(F.col("id").alias("doc"), F.explode("signature").alias("v"))
    count = posted.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    shared = posted.join(count, "v")
    ranked = shared.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("p"))
    keep = F.size("p") - F.lit(matches - 1)  # values of a single text fill the front of the prefix
    prefix = ranked.filter(keep > 0).select("doc", F.explode(F.slice("p", F.lit(1), keep)).alias("e")).select("doc", "e.v")
    left, right = prefix.select("v", F.col("doc").alias("a")), prefix.select("v", F.col("doc").alias("b"))
    return left.join(right, "v").filter("a < b").select("a", "b").distinct()


def similar_texts(
    df: DataFrame, id_col: str, text_col: str, words: int = 5, similarity: float = 0.8, min_words: int = 5, matches: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(members, links): every candidate text with its representative, and linked pairs of representatives.

    members: id, rep. links: a, b, similarity (a < b, at least ``similarity``).
    """
    coordinates, rows = signature_plan(similarity, matches)
    least = match_threshold(coordinates * rows, similarity)
    signed = cut(text_signatures(df, id_col, text_col, words, min_words, coordinates, rows))
    sets = signed.groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep"))
    members = cut(signed.select("id", "n", "set_a", "set_b").join(sets, ["n", "set_a", "set_b"]).select("id", "rep"))
    reps = signed.join(members.filter("id = rep").select("id"), "id")
    met = _meetings(reps.select("id", "signature"), matches)
    left = reps.select(F.col("id").alias("a"), F.col("minima").alias("ma"), F.col("n").alias("na"))
    right = reps.select(F.col("id").alias("b"), F.col("minima").alias("mb"), F.col("n").alias("nb"))
    count = lambda flags: F.aggregate(flags, F.lit(0), lambda s, x: s + x.cast("int"))
    equal = F.zip_with("ma", "mb", lambda x, y: x == y)
    part = lambda r: F.slice("equal", r * coordinates + 1, coordinates)
    whole = part(0)
    for r in range(1, rows):
        whole = F.zip_with(whole, part(r), lambda x, y: x & y)
    near = met.join(left, "a").join(right, "b").select("a", "b", "na", "nb", equal.alias("equal")).filter((count("equal") >= least) & (count(whole) >= matches))
    near = cut(near.select("a", "b", "na", "nb"))

    wanted = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch.iloc[:, 0], "grams": [shingle_hashes(t, words).view(np.int64) for t in batch.iloc[:, 1]]})

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    sets = texts.mapInPandas(grams, "id long, grams array<long>")
    both = F.size(F.array_intersect("ga", "gb"))
    links = (
        near.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        .withColumn("both", both)
        .select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("similarity"))
        .filter(F.col("similarity") >= similarity)
    )
    return members, cut(links)


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (a < b) of texts, copies included."""
    one, two = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    copies = one.join(two, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def version_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per text: id, class_id (least id of all it is linked to), n_copies, n_links of its representative."""
    classes = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    return (
        members.join(copies, "rep")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.coalesce("component", "rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
