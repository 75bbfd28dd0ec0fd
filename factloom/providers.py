"""Provider protocols for the model-backed steps, with dependency-free defaults.

The defaults are lexical stand-ins: they make the pipeline runnable and testable and are no
substitute for an entailment model, a language model or a trained embedder. A provider is
sent to the executors and should load its model on first use there.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.functions.text import NOT_WORD


class Judge(Protocol):
    def score(self, df: DataFrame, evidence: str, fact: str, name: str) -> DataFrame:
        """``df`` with a column ``name`` in [-1, 1]; null where there is no fact."""


class LexicalJudge:
    """2c - 1, c the share of the fact's distinct words that the evidence has; null without a fact.

    A fact without words has the share 0. Pure column expressions.
    """

    def score(self, df: DataFrame, evidence: str, fact: str, name: str) -> DataFrame:
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), NOT_WORD), lambda w: w != ""))
        asked = words(fact)
        share = F.coalesce(F.size(F.array_intersect(asked, words(evidence))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))
        return df.withColumn(name, F.when(F.col(fact).isNotNull(), 2 * share - 1))


class ModelJudge:
    """Batches of (evidence, fact) through a Python model; equal pairs are scored once.

    ``load`` makes the model on the executor: a function from two lists to a list of scores.
    A batch that fails scores 0.0 and is marked in ``<name>_error``.
    """

    def __init__(self, load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch_size: int = 32):
        self.load, self.batch_size = load, batch_size

    def score(self, df: DataFrame, evidence: str, fact: str, name: str) -> DataFrame:
        load, size = self.load, self.batch_size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                scores, failed = [], []
                for k in range(0, len(batch), size):
                    part = batch.iloc[k : k + size]
                    try:
                        scores += [float(s) for s in model(part["_e"].tolist(), part["_f"].tolist())]
                        failed += [False] * len(part)
                    except (RuntimeError, ValueError):
                        scores += [0.0] * len(part)
                        failed += [True] * len(part)
                yield batch.assign(**{name: scores, f"{name}_error": failed})

        pairs = df.filter(F.col(fact).isNotNull()).select(F.coalesce(F.col(evidence), F.lit("")).alias("_e"), F.col(fact).alias("_f")).distinct()
        scored = pairs.mapInPandas(run, f"_e string, _f string, {name} double, {name}_error boolean")
        keyed = df.withColumn("_e", F.coalesce(F.col(evidence), F.lit(""))).withColumn("_f", F.col(fact))
        return keyed.join(scored, ["_e", "_f"], "left").drop("_e", "_f")


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, name: str) -> DataFrame:
        """``df`` with a column ``name`` of unit vectors (array<float>)."""


@lru_cache(100_000)
def gram_number(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:8], 16)


class HashedNgramEmbedder:
    """Unit vectors of hashed character n-grams; the same text has the same vector everywhere.

    An n-gram's place is the first 32 bits of its md5, modulo the size.
    """

    def __init__(self, size: int = 256, n: int = 3):
        self.size, self.n = size, n

    def embed(self, df: DataFrame, text: str, name: str) -> DataFrame:
        size, n = self.size, self.n

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            out = []
            for t in texts:
                v = np.zeros(size, np.float32)
                padded = f" {(t or '').lower()} "
                for k in range(max(1, len(padded) - n + 1)):
                    v[gram_number(padded[k : k + n]) % size] += 1
                out.append(v / (np.linalg.norm(v) or 1))
            return pd.Series(out)

        return df.withColumn(name, vectors(F.col(text)))


class Extractor(Protocol):
    def extract(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """For every text its (label, name) mentions."""


class SuffixExtractor:
    """Rule-based mentions: capitalised runs that end in a known company word."""

    #: Words that end a company's name.
    ENDINGS = ("Company", "Corporation", "Group", "Holdings", "Industries", "International", "Limited", "Partners")

    def extract(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        import re

        run = re.compile(r"\b((?:[A-Z]\w+|&)(?: (?:[A-Z]\w+|&))* (?:" + "|".join(self.ENDINGS) + r"))\b")
        return [[("Organization", m) for m in run.findall(t or "")] for t in texts]


class RateGate:
    """At least 60 / rpm seconds between calls; with ``tasks`` partitions each gets its share."""

    def __init__(self, rpm: float | None, tasks: int = 1):
        self.gap = 60.0 * tasks / rpm if rpm else 0.0
        self.next = 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap
