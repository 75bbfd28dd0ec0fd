"""Score functions: bands, zones, threshold grids, softmax."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factloom.schemas import SCORE_BANDS

GRID = 100
STEP = 1.0 / (GRID - 1)


def known(score: Column) -> Column:
    """Neither null nor NaN."""
    return score.isNotNull() & ~F.isnan(score)


def score_band(score: Column) -> Column:
    """Right-closed bands over [-1, 1], the lowest end included; null outside, for null and NaN."""
    out = F.when(~known(score) | (score < -1) | (score > 1), F.lit(None).cast("string"))
    for high, name in SCORE_BANDS:
        out = out.when(score <= high, name)
    return out


def agreement_zone(score: Column) -> Column:
    """'agree' from 0.5, 'disagree' to -0.5, 'uncertain' between; null outside [-1, 1]."""
    return (
        F.when(~known(score) | (score < -1) | (score > 1), F.lit(None).cast("string"))
        .when(score >= 0.5, "agree")
        .when(score <= -0.5, "disagree")
        .otherwise("uncertain")
    )


def thresholds_passed(score: Column) -> Column:
    """How many thresholds k / 99 of the grid 0..1 the score reaches; 0 for null and NaN.

    The guess by division is put right against the very products the grid is made of.
    """
    guess = F.greatest(F.least(F.floor(score * (GRID - 1)), F.lit(GRID - 1)), F.lit(-1))
    down = F.when((guess >= 0) & (score < guess * F.lit(STEP)), guess - 1).otherwise(guess)
    up = F.when((down < GRID - 1) & (score >= (down + 1) * F.lit(STEP)), down + 1).otherwise(down)
    return F.when(known(score), up + 1).otherwise(0).cast("int")


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities of parallel logit columns."""
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return [p / total for p in powers]


def truth_score(entailed: Column, contradicted: Column) -> Column:
    """P(entailed) - P(contradicted), in [-1, 1]."""
    return entailed - contradicted
