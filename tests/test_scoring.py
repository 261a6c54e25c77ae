"""Golden rows of confidence, quality, calibration bins; properties of the scores."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notemill.functions import scoring as sc
from notemill.operators import calibration as cal
from notemill.operators import validation as va

CONFIDENCE = [(0.84, 0.7, 0.7333333333), (0.7, 0.7, 0.5), (0.35, 0.7, 0.25), (-0.2, 0.7, 0.0), (1.0, 0.9, 1.0),
              (1.0, 1.0, 1.0), (-0.1, 0.0, 0.0)]


def test_confidence(spark):
    df = spark.createDataFrame(CONFIDENCE, "s double, t double, want double")
    for r in df.select("want", sc.confidence(F.col("s"), F.col("t")).alias("c")).collect():
        assert r["c"] == pytest.approx(r["want"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(0.01, 0.99)), min_size=2, max_size=50))
def test_confidence_is_bounded_and_monotone(spark, pairs):
    t = pairs[0][1]
    df = spark.createDataFrame([(float(s), float(t)) for s, _ in pairs], "s double, t double")
    rows = sorted((r["s"], r["c"]) for r in df.select("s", sc.confidence(F.col("s"), F.col("t")).alias("c")).collect())
    scores = [c for _, c in rows]
    assert all(0 <= c <= 1 for c in scores) and scores == sorted(scores)


def test_quality(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.7), (0, 3, 0.7), (5, 2, 0.0)], "e int, w int, want double")
    for r in df.select("want", sc.quality_score(F.col("e"), F.col("w")).alias("q")).collect():
        assert r["q"] == r["want"]


def test_bins(spark):
    assert sc.bin_edges() == np.linspace(0, 1, 11).tolist()
    cases = [(0.0, None), (0.1, 1), (0.10001, 2), (0.30000000000000004, 3), (1.0, 10)]
    df = spark.createDataFrame(cases, "p double, want int")
    for r in df.select("want", sc.right_closed_bin(F.col("p")).alias("b")).collect():
        assert r["b"] == r["want"]


def test_note_validation_golden_rows(spark):
    cases = [("", ["length_error", "content_error"], 3, 0.3), ("!!", ["length_error"], 2, 0.6),
             ("a" * 12, [], 1, 0.9), ("fix the bug today", [], 0, 1.0)]
    df = spark.createDataFrame([(t, f"n{i}", "2025-01-27T10:30:00") for i, (t, *_) in enumerate(cases)],
                               "text string, note_id string, timestamp string")
    for r, (_, errors, warnings, quality) in zip(va.validate_notes(df).orderBy("note_id").collect(), cases):
        assert [e["error_type"] for e in r["errors"]] == errors
        assert len(r["warnings"]) == warnings and r["quality"] == quality


def test_missing_fields(spark):
    df = spark.createDataFrame([(None, None, None)], "text string, note_id string, timestamp string")
    row = va.validate_notes(df).first()
    assert [e["error_type"] for e in row["errors"]] == ["missing_field"] * 3 and row["quality"] == 0.4


def test_tag_validation(spark):
    rows = [("Bad Name", "too short", ["abcdef", "abcdef", "x"], 1.5), ("good", "a long description", ["example"], 0.5)]
    df = spark.createDataFrame(rows, "tag string, description string, examples array<string>, confidence_threshold double")
    bad, good = va.validate_tags(df).orderBy("tag").collect()
    assert [e["error_type"] for e in bad["errors"]] == ["pattern_error", "length_error", "value_error"]
    assert [w["field"] for w in bad["warnings"]] == ["examples[1]", "examples[2]"]
    assert good["is_valid"] and good["quality"] == 1.0


def _newton(x, y, n):
    """Minimum of 0.5 w^2 + summed log loss with a free intercept."""
    w = np.zeros(2)
    features = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-features @ w))
        gradient = features.T @ (p - y) + np.array([w[0], 0])
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag([1.0, 0.0])
        w -= np.linalg.solve(hessian, gradient)
    return w


def test_platt_matches_newton(spark, tmp_path):
    from notemill.operators.evaluation import stratified_split
    from notemill.sources import writers as wr

    rng = np.random.default_rng(3)
    s = rng.uniform(0, 1, 600)
    y = rng.uniform(0, 1, 600) < 1 / (1 + np.exp(-(4 * s - 2)))
    df = spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(s, y))],
                               "note_id int, score double, correct boolean")
    fitted = cal.fit_platt(df)
    train = stratified_split(df, "correct", "note_id").filter("is_train").toPandas()
    want = _newton(train["score"].to_numpy(), train["correct"].to_numpy(dtype="float64"), len(train))
    assert fitted.coefficient == pytest.approx(want[0], abs=1e-4)
    assert fitted.intercept == pytest.approx(want[1], abs=1e-4)
    wr.save_calibrator(spark, fitted, f"{tmp_path}/cal")
    assert wr.load_calibrator(spark, f"{tmp_path}/cal") == fitted
    with pytest.raises(RuntimeError):
        wr.save_calibrator(spark, cal.Calibrator(), f"{tmp_path}/none")
    with pytest.raises(RuntimeError):
        cal.Calibrator().predict(F.lit(0.1))


def test_calibration_error(spark):
    rows = [(0.0, True), (0.05, False), (0.95, True), (0.95, False)]
    out = cal.calibration_error(spark.createDataFrame(rows, "p double, y boolean"), "p", "y").first()
    assert out["expected_calibration_error"] == pytest.approx((0.05 + abs(1 - 1.9)) / 4)
    assert out["brier_score"] == pytest.approx((1 + 0.0025 + 0.0025 + 0.9025) / 4)
    bins = cal.reliability_bins(spark.createDataFrame(rows, "p double, y boolean"), "p", "y").orderBy("bin").collect()
    assert [(b["bin"], b["n"]) for b in bins] == [(1, 2), (10, 2)]
