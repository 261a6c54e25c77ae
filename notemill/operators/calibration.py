"""Confidence calibration: Platt scaling, Brier score, calibration error, reliability bins."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import scoring as sc
from notemill.operators.evaluation import stratified_split
from notemill.runtime import cut_lineage


@dataclass(frozen=True)
class Calibrator:
    """Two fitted numbers; ``None`` means unfitted."""

    coefficient: float | None = None
    intercept: float | None = None
    method: str = "platt"

    @property
    def is_fitted(self) -> bool:
        return self.coefficient is not None

    def _columns(self) -> tuple[Column, Column]:
        return F.lit(self.coefficient).cast("double"), F.lit(self.intercept).cast("double")

    def predict(self, score: Column) -> Column:
        if not self.is_fitted:
            raise RuntimeError("the calibrator must be fitted before prediction")
        return sc.platt(score, *self._columns())

    def calibrate(self, score: Column, threshold: Column) -> Column:
        return sc.calibrated_confidence(score, threshold, *self._columns())

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.range(1).select(
            F.lit(self.method).alias("method"), F.lit(self.is_fitted).alias("is_fitted"),
            F.struct(F.lit(self.intercept).cast("double").alias("intercept"),
                     F.lit(self.coefficient).cast("double").alias("coefficient")).alias("parameters"),
        )


def calibration_dataset(results: DataFrame, truth: DataFrame | None = None, note_id: str = "note_id") -> DataFrame:
    """Adds ``score`` and ``correct``; a missing score is 0, missing tags are empty and equal."""
    joined = results.join(truth.select(note_id, "true_tag"), note_id, "left") if truth is not None else results
    tag = lambda c: F.coalesce(c, F.lit(""))
    return joined.withColumn("score", F.coalesce("similarity_score", F.lit(0.0))).withColumn(
        "correct", tag("routed_tag") == tag("true_tag"))


def training_part(data: DataFrame, score: str = "score", correct: str = "correct", id_col: str = "note_id",
                  validation: float = 0.2, seed: int = 42) -> DataFrame:
    """(score, y) of the stratified training part; rows without an outcome are left out."""
    known = data.select(id_col, F.col(score).cast("double").alias("score"), F.col(correct).alias("correct")).filter(
        F.col("correct").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    return stratified_split(known, "correct", id_col, validation, seed).filter("is_train").select(
        "score", F.col("correct").cast("double").alias("y"))


def newton_sums(train: DataFrame, coefficient: float, intercept: float) -> tuple[float, ...]:
    """Loss, both gradients and the three entries of the curvature over (score, y), from one aggregate.

    The loss is the summed log loss plus half the squared coefficient.
    """
    s, y = F.col("score"), F.col("y")
    z = s * coefficient + intercept
    p = 1 / (1 + F.exp(-z))
    w = p * (1 - p)
    # log(1 + exp(z)) without overflow
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z
    row = train.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in (loss, (p - y) * s, p - y, w * s * s, w * s, w)]).first()
    total, g_a, g_b, h_aa, h_ab, h_bb = row
    return total + coefficient ** 2 / 2, g_a + coefficient, g_b, h_aa + 1.0, h_ab, h_bb


def fit_platt(data: DataFrame, score: str = "score", correct: str = "correct", id_col: str = "note_id",
              validation: float = 0.2, seed: int = 42, tolerance: float = 1e-9, max_steps: int = 50) -> Calibrator:
    """Logistic regression of correctness on the score over a stratified training part.

    The penalty is a unit-strength L2 term on the coefficient beside the summed loss. The slim
    training rows are written once; every Newton step is one aggregate of six sums over them,
    halved while it would raise the loss.

    Without training rows the calibrator is unfitted. With one outcome only, the coefficient is 0
    and the probability is that outcome's rate with one success and one failure added.
    """
    train = cut_lineage(training_part(data, score, correct, id_col, validation, seed))
    n, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n:
        return Calibrator()
    if ones in (0, n):
        return Calibrator(0.0, math.log((ones + 1) / (n - ones + 1)))
    a, b = 0.0, math.log(ones / (n - ones))
    sums = newton_sums(train, a, b)
    for _ in range(max_steps):
        loss, g_a, g_b, h_aa, h_ab, h_bb = sums
        if max(abs(g_a), abs(g_b)) <= tolerance * n:
            break
        det = h_aa * h_bb - h_ab * h_ab
        d_a, d_b = (h_bb * g_a - h_ab * g_b) / det, (h_aa * g_b - h_ab * g_a) / det
        size, sums = 1.0, newton_sums(train, a - d_a, b - d_b)
        while sums[0] > loss + 1e-12 * abs(loss) and size > 1e-6:
            size /= 2
            sums = newton_sums(train, a - size * d_a, b - size * d_b)
        a, b = a - size * d_a, b - size * d_b
    return Calibrator(a, b)


def brier(p: Column, correct: Column) -> Column:
    """Aggregate: mean squared gap between probability and outcome."""
    gap = p - correct.cast("double")
    return F.avg(gap * gap)


def reliability_bins(data: DataFrame, p: str, correct: str, n_bins: int = 10) -> DataFrame:
    """Per non-empty bin: rows, share of positives, mean prediction. The first bin includes 0."""
    binned = data.withColumn("bin", sc.right_closed_bin(F.col(p), n_bins, first_includes_zero=True))
    return binned.filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(correct).cast("double")).alias("fraction_of_positives"),
        F.avg(p).alias("mean_predicted_value"),
    )


def calibration_error(data: DataFrame, p: str, correct: str, n_bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score from one pass of bin sums.

    A probability of exactly 0 lies in no bin but counts in the total.
    """
    hit, prob = F.col(correct).cast("double"), F.col(p)
    bins = data.withColumn("bin", sc.right_closed_bin(prob, n_bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.sum(prob).alias("mass"),
        F.sum((prob - hit) * (prob - hit)).alias("squares"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("hits") - F.col("mass"))).otherwise(0.0)
    total = F.sum("n")
    return bins.agg(
        (F.sum("squares") / total).alias("brier_score"),
        (F.sum(gap) / total).alias("expected_calibration_error"),
        total.alias("n"),
    )


def calibration_report(data: DataFrame, calibrator: Calibrator, score: str = "score",
                       correct: str = "correct") -> DataFrame:
    """Brier score of the raw and of the calibrated scores."""
    scored = data.withColumn("calibrated", calibrator.predict(F.col(score)))
    return scored.agg(
        brier(F.col(score), F.col(correct)).alias("brier_score_before"),
        brier(F.col("calibrated"), F.col(correct)).alias("brier_score_after"),
        F.count(F.lit(1)).alias("n"),
    )


def calibrate_by_threshold(results: DataFrame, params: DataFrame, score: str = "similarity_score",
                           threshold: str = "threshold") -> DataFrame:
    """Sigmoid with slope and midpoint looked up per threshold; (1, 0) where none is known."""
    looked = results.join(params.select(F.col("threshold").alias(threshold), "slope", "midpoint"), threshold, "left")
    return looked.withColumn("calibrated", sc.platt_shifted(
        F.col(score), F.coalesce("slope", F.lit(1.0)), F.coalesce("midpoint", F.lit(0.0)))).drop("slope", "midpoint")
