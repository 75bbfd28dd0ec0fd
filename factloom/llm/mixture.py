"""Mixing sources to target weights by weighted sampling without replacement.

Every distinct text of a wanted source gets the key -ln(u) / weight (Efraimidis and
Spirakis), u from a hash of its id and the seed, the weight a column of document quality, and
is taken in the order of its key until the source's token budget is used. Budgets over a
source's tokens first take complete epochs of all its texts, then the fractional rest in key
order.

The running token sums of a hot source are never built in one task: each source's keys fall
into ``BLOCKS`` ranges between quantiles of its own keys, so the ranges are of one size
whatever the weights are; sums of whole ranges are added up over that small table, and only
inside a range are rows sorted. Tokens are counted with a public tokenizer, once per row of
the wanted sources. Per-source tables are broadcast for up to ``BROADCAST_ROWS`` rows and
joined by shuffle beyond.

The total is the largest at which every source that has tokens reaches its share within its
number of repeats, unless ``total_tokens`` is given; then sources that fall short are
reported with the share they reach.

Defined results: null and empty texts and null sources are not used; equal texts count once,
with the least id; sources without texts or with null, zero or negative shares are reported
with 0 tokens; shares are scaled to a sum of 1; null repeats count as 1; a source named
twice in the targets has the sum of its shares and the largest repeats; a quality that is
null or not above 0 counts as 0.000001.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from factloom.functions.tokens import token_counter
from factloom.llm.cutoff import BROADCAST_ROWS, sender
from factloom.plans.session import cut

#: Key ranges of a source, found in two steps of their root.
BLOCKS, STEP = 256, 16


def count_tokens(df: DataFrame, text_col: str, keep: list[Column], schema: str, vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns (as declared in ``schema``) and n_tokens; the text itself is dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(vocabulary)
        for batch in batches:
            out = batch.iloc[:, 1:].copy()
            out["n_tokens"] = count(batch.iloc[:, 0].tolist())
            yield out

    return df.select(F.col(text_col), *keep).mapInPandas(run, schema + ", n_tokens long")


def key_blocks(keyed: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keyed`` (source, key, ...) with ``block``: the range between quantiles of its source's keys that the key falls into."""
    shares = F.array(*[F.lit(k / BLOCKS) for k in range(1, BLOCKS)])
    bounds = cut(keyed.groupBy("source").agg(F.percentile_approx("key", shares, F.lit(4 * BLOCKS)).alias("bounds")))
    coarse = F.filter("bounds", lambda b, k: ((k + 1) % STEP == 0) & (b < F.col("key")))
    with_coarse = keyed.join(sender(bounds, broadcast_rows)(bounds), "source").withColumn("coarse", F.size(coarse))
    fine = F.filter(F.slice("bounds", F.col("coarse") * STEP + 1, F.lit(STEP - 1)), lambda b: b < F.col("key"))
    return with_coarse.withColumn("block", F.col("coarse") * STEP + F.size(fine)).drop("bounds", "coarse")


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality_col: str | None = None,
    total_tokens: int | None = None,
    seed: int = 7,
    vocabulary: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: id, source, n_tokens, copies (at least 1). shares: source, target_share,
    actual_share, tokens, available_tokens, n_texts, max_repeats. ``quality_col`` holds the
    weights; without it all documents weigh the same.
    """
    entries = targets.filter("source is not null").groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(1)).cast("long").alias("max_repeats")
    )
    entries = cut(entries)
    send = sender(entries, broadcast_rows)

    quality = F.lit(1.0) if quality_col is None else F.col(quality_col).cast("double")
    quality = F.when(quality > 1e-6, quality).otherwise(F.lit(1e-6))
    wanted = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), quality.alias("quality"))
    wanted = wanted.filter("id is not null and length(text) > 0").join(send(entries.select("source")), "source")
    schema = "id long, source string, digest binary, quality double"
    keep = [F.col("id"), F.col("source"), F.unhex(F.md5("text")).alias("digest"), F.col("quality")]
    counted = count_tokens(wanted, "text", keep, schema, vocabulary)
    once = counted.groupBy("digest").agg(F.min_by(F.struct("id", "source", "quality", "n_tokens"), "id").alias("r")).select("r.*")

    # u in (0, 1): the upper 52 bits of a hash, so neither 0 nor 1
    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = cut(once.select("id", "source", "n_tokens", (-F.log(u) / F.col("quality")).alias("key")))
    keyed = cut(key_blocks(keyed, broadcast_rows))

    sums = cut(keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    have = sums.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum("n").alias("n_texts"))
    have = cut(entries.join(send(have), "source", "left").fillna(0, ["available_tokens", "n_texts"]))
    whole = have.agg(F.sum("share")).first()[0] or 1.0
    target = F.col("share") / whole
    if total_tokens is None:
        reach = F.floor(F.col("available_tokens") * F.col("max_repeats") / target)
        total_tokens = have.filter("share > 0 and available_tokens > 0").agg(F.min(reach)).first()[0] or 0
    budget = F.least(F.floor(target * total_tokens), F.col("available_tokens") * F.col("max_repeats"))
    epochs = F.coalesce(F.floor(F.col("budget") / F.nullif("available_tokens", F.lit(0))), F.lit(0))
    plan = have.select("source", target.alias("target_share"), "max_repeats", "available_tokens", "n_texts", budget.alias("budget")).withColumn("epochs", epochs)
    plan = cut(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available_tokens")))

    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(sums.select("source", "block", F.coalesce(F.sum("tokens").over(by_block), F.lit(0)).alias("before")))
    inside = Window.partitionBy("source", "block").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    running = keyed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    middle = F.col("before") + F.col("inside") + F.col("n_tokens") / 2  # the text at the limit is taken if most of it fits
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & (middle <= F.col("rest")), 1).otherwise(0)
    mixture = (
        running.join(sender(before, broadcast_rows)(before), ["source", "block"])
        .join(send(plan.select("source", "epochs", "rest")), "source")
        .select("id", "source", "n_tokens", copies.cast("int").alias("copies"))
        .filter("copies > 0")
    )
    mixture = cut(mixture)
    taken = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    everything = max(taken.agg(F.sum("tokens")).first()[0] or 0, 1)
    taken = plan.join(send(taken), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    shares = taken.select("source", "target_share", (F.col("tokens") / everything).alias("actual_share"), "tokens", "available_tokens", "n_texts", "max_repeats")
    return mixture, shares
