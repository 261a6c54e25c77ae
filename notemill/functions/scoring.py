"""Scores: confidence, quality, calibration and their bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def confidence(similarity: Column, threshold: Column) -> Column:
    """Piecewise-linear confidence: 0.5 at the threshold, 1 at similarity 1, 0 at similarity 0."""
    above = F.coalesce(0.5 + 0.5 * F.try_divide(similarity - threshold, 1.0 - threshold), F.lit(1.0))
    below = F.coalesce(0.5 * F.try_divide(similarity, threshold), F.lit(0.0))
    return clamp01(F.when(similarity >= threshold, above).otherwise(below))


def quality_score(n_errors: Column, n_warnings: Column) -> Column:
    """1 - (2 errors + warnings) / 10, floored at 0, half-even rounded to 3 places."""
    return F.bround(F.greatest(F.lit(0.0), 1.0 - (n_errors * 2 + n_warnings) / F.lit(10.0)), 3)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def platt(score: Column, coefficient: Column, intercept: Column) -> Column:
    return sigmoid(coefficient * score + intercept)


def platt_shifted(score: Column, slope: Column, midpoint: Column) -> Column:
    """The per-threshold variant: sigmoid of ``slope * (score - midpoint)``."""
    return sigmoid(slope * (score - midpoint))


def calibrated_confidence(score: Column, threshold: Column, coefficient: Column, intercept: Column) -> Column:
    """Platt probability, reduced below the tag threshold, clamped; plain confidence if unfitted."""
    prob = platt(score, coefficient, intercept)
    reduced = prob * F.coalesce(F.try_divide(score, threshold), F.lit(0.0))
    fitted = coefficient.isNotNull() & intercept.isNotNull()
    return F.when(fitted, clamp01(F.when(score < threshold, reduced).otherwise(prob))).otherwise(
        confidence(score, threshold)
    )


def bin_edges(n_bins: int = 10) -> list[float]:
    """Equal-width edges as ``i * (1 / n)``, which is what linspace yields bit for bit."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def right_closed_bin(p: Column, n_bins: int = 10, first_includes_zero: bool = False) -> Column:
    """Bin number 1..n with ``lo < p <= hi``; p = 0 is in no bin unless asked for."""
    edges = bin_edges(n_bins)
    low = p >= 0 if first_includes_zero else p > 0
    found = F.when(low & (p <= edges[1]), 1)
    for i in range(2, n_bins + 1):
        found = found.when((p > edges[i - 1]) & (p <= edges[i]), i)
    return found
