"""Analytics over the score table: counts, curves, bands, distributions, densities, co-occurrence.

Everything is folded to (group, score) or (group, bin) before it is expanded, so what is
shuffled follows the number of groups and not of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from factloom.functions.scores import GRID, STEP, known, thresholds_passed
from factloom.operators.texts import distinct_texts


def facts_by_name(facts: DataFrame, order: str) -> DataFrame:
    """type, name, n of the first row of every fact (null facts count as one fact)."""
    return distinct_texts(facts.select(order, "fact", "type", "name"), order, "fact").groupBy("type", "name").agg(F.count("*").alias("n"))


def acceptance_curve(facts: DataFrame, group: str) -> DataFrame:
    """group, threshold_no, threshold, accept_rate: the share of rows with a score at or above each of 100 thresholds.

    Null and NaN scores are never accepted and count in the whole. Rows are folded to the
    number of thresholds they pass; the curve is a running sum over at most 101 rows a group.
    """
    folded = facts.filter(F.col(group).isNotNull()).groupBy(group, thresholds_passed(F.col("score")).alias("passed")).agg(F.count("*").alias("n"))
    curve = folded.groupBy(group).agg(F.sum("n").alias("whole"), F.map_from_entries(F.collect_list(F.struct("passed", "n"))).alias("by"))
    rows = curve.select(group, "whole", "by", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("threshold_no"))
    # passed the k-th threshold: counted under k + 1 and above
    above = F.aggregate(F.map_entries("by"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] > F.col("threshold_no"), e["value"]).otherwise(0))
    return rows.select(group, "threshold_no", (F.col("threshold_no") * F.lit(STEP)).alias("threshold"), (above / F.col("whole")).alias("accept_rate"))


def count_by(facts: DataFrame, *groups) -> DataFrame:
    return facts.groupBy(*groups).agg(F.count("*").alias("n"))


def mean_by_name(facts: DataFrame) -> DataFrame:
    """name, n, mean_score over scores that are neither null nor NaN."""
    return facts.filter(F.col("name").isNotNull() & known(F.col("score"))).groupBy("name").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def score_distribution(facts: DataFrame, *groups: str) -> DataFrame:
    """Groups with n, min, quartiles, max and mean; scores are folded before the exact percentiles."""
    folded = facts.filter(known(F.col("score"))).groupBy(*groups, "score").agg(F.count("*").alias("c"))
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("c"))
    out = folded.groupBy(*groups).agg(F.sum("c").alias("n"), F.min("score").alias("low"), q.alias("q"), F.max("score").alias("high"), (F.sum(F.col("score") * F.col("c")) / F.sum("c")).alias("mean_score"))
    return out.select(*groups, "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", "mean_score")


def score_density(facts: DataFrame, group: str, points: int = 200, adjust: float = 0.8, stretch: float = 3.0) -> DataFrame:
    """group, point, x, density: a Gaussian density by Scott's rule times ``adjust``.

    The grid runs from ``stretch`` bandwidths under the least to as many over the greatest
    score. Groups with fewer than two scores or without spread have no curve. Equal scores
    are folded first, and partial sums keep what is shuffled to groups x points.
    """
    folded = facts.filter(F.col(group).isNotNull() & known(F.col("score"))).groupBy(group, "score").agg(F.count("*").alias("c"))
    n, s = F.sum("c"), F.sum(F.col("c") * F.col("score"))
    shape = folded.groupBy(group).agg(n.alias("n"), (s / n).alias("m"), F.min("score").alias("low"), F.max("score").alias("high"))
    centred = folded.join(shape, group)
    spread = centred.groupBy(group, "n", "low", "high").agg(F.sum(F.col("c") * F.pow(F.col("score") - F.col("m"), 2)).alias("ss"))
    bw = F.lit(adjust) * F.pow(F.col("n").cast("double"), -0.2) * F.sqrt(F.col("ss") / (F.col("n") - 1))
    usable = spread.filter("n > 1 and ss > 0").withColumn("bw", bw)
    start, end = F.col("low") - stretch * F.col("bw"), F.col("high") + stretch * F.col("bw")
    laid = folded.join(usable.select(group, "n", "bw", start.alias("start"), ((end - start) / (points - 1)).alias("step")), group)
    each = laid.select(group, "score", "c", "n", "bw", "start", "step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("start") + F.col("point") * F.col("step")
    z = (x - F.col("score")) / F.col("bw")
    total = each.groupBy(group, "point", x.alias("x"), "n", "bw").agg(F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("k"))
    return total.select(group, "point", "x", (F.col("k") / (F.col("n") * F.col("bw") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))


def cooccurrence_pairs(facts: DataFrame, unit: str = "evidence") -> DataFrame:
    """a, b (a < b), w: units (evidence texts, or their chunks) in which both names occur.

    Null and empty names and units don't count. The names of a unit are a set folded before
    the shuffle, which is keyed by a digest of the unit.
    """
    some = facts.filter((F.col(unit).cast("string") != "") & (F.col("name") != ""))
    names = some.groupBy(F.unhex(F.md5(F.col(unit).cast("string"))).alias("e")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    # folding equal sets leaves a few rows however many evidences there are
    sets = names.filter(F.size("names") > 1).groupBy("names").agg(F.count("*").alias("n"))
    first = sets.select("n", "names", F.posexplode("names").alias("k", "a"))
    return first.select("n", "a", F.explode(F.slice("names", F.col("k") + 2, F.size("names"))).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("w"))


def symmetric_weights(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def weighted_degrees(symmetric: DataFrame) -> DataFrame:
    """name, degree: weights summed over both sides of the mirrored pairs, so every edge counts twice."""
    return symmetric.select(F.explode(F.array("a", "b")).alias("name"), "w").groupBy("name").agg(F.sum("w").alias("degree"))


def top_names(degrees: DataFrame, limit: int = 30) -> DataFrame:
    """The names of greatest degree, ties by name."""
    return degrees.orderBy(F.desc("degree"), "name").limit(limit)


def dense_matrix(symmetric: DataFrame, names: DataFrame) -> DataFrame:
    """a, b, w for every two of a few names, 0 where they never meet.

    The list of names is one small row that is exploded on both sides.
    """
    listed = names.agg(F.array_sort(F.collect_set("name")).alias("all"))
    cells = listed.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b"))
    return cells.join(symmetric.select("a", "b", "w"), ["a", "b"], "left").select("a", "b", F.coalesce("w", F.lit(0)).cast("long").alias("w"))


def wide_matrix(dense: DataFrame, names: list[str]) -> DataFrame:
    """The matrix with one column per name."""
    return dense.groupBy("a").pivot("b", sorted(names)).agg(F.first("w"))


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """column, first: every value with the least ``order`` it has; sorted by it that is the order of appearance. Null is a value."""
    return df.groupBy(column).agg(F.min(order).alias("first"))


def preview(df: DataFrame, order: str, limit: int = 5) -> DataFrame:
    """The first rows by ``order``: a top-k, never a global sort."""
    return df.orderBy(order).limit(limit)


def review_queue(facts: DataFrame, order: str, limit: int) -> DataFrame:
    """Our addition: the facts nearest to a score of 0, ties by ``order``."""
    return facts.filter(known(F.col("score"))).orderBy(F.abs("score"), order).limit(limit)


def running_share(counts: DataFrame, group: str) -> DataFrame:
    """Counts with each row's share of its group."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
