"""Score cutoffs that keep a target fraction of every group, by histogram refinement.

Each round counts the groups' scores into bins between known bounds, with the least and the
greatest score of every bin; the bin that holds the wanted rank is zoomed into until it
holds one score. Bounds are taken from the scores themselves, so the cutoff is exact at any
spread and with any ties. A round is one aggregation with map-side combine: what is shuffled
is groups x bins, whatever the number of rows, and no group is ever sorted or gathered. The
bin is picked by a window over a group's bins, and the bounds are a table too: nothing but
the number of open groups comes to the driver. Bounds are broadcast for up to
``BROADCAST_ROWS`` targets and joined by shuffle beyond.

Defined results: rows with a null, NaN or out-of-range score, or of no entry, don't count;
an entry without rows gets a null cutoff and 0 kept; a null share keeps nothing; shares of 0
or less keep the highest score, shares over the whole keep all; an entry given twice under
one key takes the largest share; ties at the cutoff are all kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from factloom.functions.text import alnum_key
from factloom.plans.session import cut

BROADCAST_ROWS = 100_000


def group_keys(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and one key column per given column (letters and digits only)."""
    return df.select(*keep, *[alnum_key(F.col(c)).alias(f"key_{k}") for k, c in enumerate(columns)])


def sender(df: DataFrame, most: int):
    """``F.broadcast`` if ``df`` has at most ``most`` rows, else a function that leaves the join to the planner."""
    return F.broadcast if df.limit(most + 1).count() <= most else lambda small: small


def score_cutoffs(scores: DataFrame, targets: DataFrame, keys: list[str], score: str, permille: str, bins: int = 512, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per key: n, cutoff, n_kept. ``scores`` holds ``keys`` and a valid ``score``."""
    wanted = cut(targets.groupBy(*keys).agg(F.max(permille).alias("permille")))
    send = sender(wanted, broadcast_rows)
    inside = scores.join(send(wanted.select(*keys)), keys)

    whole = inside.groupBy(*keys).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"))
    rank = F.least(F.greatest(F.floor((F.col("n") * F.col("permille") + 999) / 1000), F.lit(1)), F.col("n"))
    state = whole.join(send(wanted.filter("permille is not null")), keys).select(*keys, "n", rank.alias("rank"), F.lit(0).cast("long").alias("above"), "low", "high", F.col("n").alias("kept"))
    state = cut(state)
    done = state.filter("low = high")
    while (open_ := state.filter("low < high")).limit(1).count():
        zoomed = inside.join(send(open_.select(*keys, "low", "high")), keys).filter(F.col(score).between(F.col("low"), F.col("high")))
        # halves keep the width finite even between the greatest doubles
        place = (F.col(score) / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        counted = zoomed.groupBy(*keys, F.least(F.floor(place * bins), F.lit(bins - 1)).alias("bin")).agg(
            F.count("*").alias("c"), F.min(score).alias("low"), F.max(score).alias("high")
        )
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
        reached = counted.withColumn("upto", upto).join(send(open_.select(*keys, "n", "rank", "above")), keys).filter(F.col("above") + F.col("upto") >= F.col("rank"))
        hit = reached.groupBy(*keys).agg(F.max_by(F.struct("n", "rank", "above", "upto", "c", "low", "high"), "bin").alias("h"))
        above = F.col("h.above") + F.col("h.upto")
        state = cut(hit.select(*keys, "h.n", "h.rank", (above - F.col("h.c")).alias("above"), "h.low", "h.high", above.alias("kept")))
        done = done.unionByName(state.filter("low = high"))
    out = wanted.join(send(done), keys, "left")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.col("low").alias("cutoff"), F.coalesce("kept", F.lit(0)).alias("n_kept"))


def keep_by_target(
    df: DataFrame, targets: DataFrame, id_col: str, columns: list[str], score: str, permille: str, low: float = -1.0, high: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """(cutoffs, kept): the report per entry, and id, key columns and score of every kept row."""
    keys = [f"key_{k}" for k in range(len(columns))]
    valid = F.col(score).isNotNull() & ~F.isnan(score) & F.col(score).between(low, high)
    scores = group_keys(df.filter(valid), columns, [F.col(id_col), F.col(score).cast("double").alias("score")])
    entries = group_keys(targets, columns, [F.col(permille).alias("permille")]).dropna(subset=keys)
    cutoffs = cut(score_cutoffs(scores, entries, keys, "score", "permille"))
    kept = scores.join(sender(cutoffs, BROADCAST_ROWS)(cutoffs), keys).filter(F.col("score") >= F.col("cutoff")).select(id_col, *keys, "score")
    return cutoffs, kept
