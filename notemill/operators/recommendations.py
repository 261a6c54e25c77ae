"""Advice from measured values: rules over one-row aggregates, returned as rows.

A rule compares a value with a bound. Its row has the rule's code, the value, the bound, what it
is about (a tag, a model, an error type; else NULL) and a sentence for readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a sentence for each code; what the row is about is put behind a colon
SENTENCES = {
    "precision": "Too many notes get a wrong tag; raise the thresholds",
    "recall": "Too many notes miss their tag; add examples to the tags",
    "confidence": "Confidence hardly follows correctness; fit a calibrator",
    "time": "A note takes longer than the target",
    "weak_tag": "This tag is seldom right; look at its examples",
    "no_model": "There is no model to compare",
    "all_models_weak": "The best of the models is still below the target",
    "all_models_slow": "Not one model is as fast as the target",
    "all_models_large": "Not one model is as small as the target",
    "strong_model": "This model is good enough to be used",
    "bargain_model": "This model is nearly as good as the best and much faster",
    "many_invalid": "A large part of the items is invalid; look at their source",
    "errors_over_warnings": "Items fail much oftener than they are doubtful; look at the format",
    "frequent_error": "One kind of error is common",
    "invalid_captures": "Some lines break the grammar",
    "few_tags": "Notes carry few tags",
    "failed_routes": "Many notes could not be routed",
    "low_confidence": "Notes are routed with little confidence",
    "ignored_tags": "Notes are seldom routed to the tags that users gave them",
    "invalid_input": "There are invalid notes in the input",
    "outliers": "There are notes of unusual length",
    "weak_model": "The best model is below the target",
    "little_gain": "Calibration gains next to nothing",
    "slow_run": "The run takes longer per note than the target",
}
_ADVICE = "struct<code:string,value:double,bound:double,about:string>"


def _advice(code: str, holds: Column, value: Column, bound: float | None = None, about: Column | None = None) -> Column:
    return F.when(holds, F.struct(
        F.lit(code).alias("code"), value.cast("double").alias("value"), F.lit(bound).cast("double").alias("bound"),
        (about if about is not None else F.lit(None)).cast("string").alias("about")))


def _below(code: str, column: str, bound: float) -> Column:
    return _advice(code, F.col(column) < bound, F.col(column), bound)


def _above(code: str, column: str, bound: float) -> Column:
    return _advice(code, F.col(column) > bound, F.col(column), bound)


def sentence(code: Column, about: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    return F.concat(F.element_at(texts, code), F.coalesce(F.concat(F.lit(": "), about), F.lit("")))


def _rows(row: DataFrame, rules: list[Column], more: Column | None = None) -> DataFrame:
    found = F.array_compact(F.array(*rules))
    if more is not None:
        found = F.concat(found, F.coalesce(more, F.array().cast(f"array<{_ADVICE}>")))
    listed = row.select(F.posexplode(found).alias("position", "a")).select("position", "a.*")
    return listed.withColumn("recommendation", sentence(F.col("code"), F.col("about")))


def evaluation_recommendations(metrics: DataFrame, per_tag: DataFrame) -> DataFrame:
    """From one metrics row and the per-tag table: the scores, and the three worst tags under F1 0.5."""
    worst = per_tag.orderBy("f1_score", "tag").limit(3).filter("f1_score < 0.5")
    ordered = worst.agg(F.array_sort(F.collect_list(F.struct("f1_score", "tag"))))
    weak = F.transform("_worst", lambda w: F.struct(
        F.lit("weak_tag").alias("code"), w["f1_score"].alias("value"), F.lit(0.5).alias("bound"), w["tag"].alias("about")))
    rules = [_below("precision", "precision", 0.8), _below("recall", "recall", 0.7),
             _below("confidence", "confidence_correlation", 0.3), _above("time", "processing_time_ms", 100)]
    return _rows(metrics.withColumn("_worst", ordered.scalar()), rules, weak)


def model_recommendations(comparison: DataFrame) -> DataFrame:
    """From the model comparison table (one row per model)."""
    ranked = F.array_sort(F.collect_list(F.struct(
        (-F.col("f1_score")).alias("neg"), "model_name", "f1_score", "processing_time_ms")))
    row = comparison.agg(
        F.count(F.lit(1)).alias("n"), F.min("processing_time_ms").alias("fastest"), F.min("memory_usage_mb").alias("smallest"),
        ranked.alias("models"),
    ).select("*", F.get("models", F.lit(0)).alias("best"), F.get("models", F.lit(1)).alias("second"))
    f1, gap = F.col("best.f1_score"), F.col("best.f1_score") - F.col("second.f1_score")
    bargain = (gap < 0.05) & (F.col("second.processing_time_ms") < F.col("best.processing_time_ms") * 0.7)
    return _rows(row, [
        _advice("no_model", F.col("n") == 0, F.col("n"), 1),
        _advice("all_models_weak", f1 < 0.7, f1, 0.7),
        _advice("all_models_slow", F.col("fastest") >= 50, F.col("fastest"), 50),
        _advice("all_models_large", F.col("smallest") >= 500, F.col("smallest"), 500),
        _advice("strong_model", f1 > 0.8, f1, 0.8, F.col("best.model_name")),
        _advice("bargain_model", bargain, gap, 0.05, F.col("second.model_name")),
    ])


def validation_recommendations(summary: DataFrame, error_types: DataFrame) -> DataFrame:
    """From the validation summary row and the error-type counts."""
    packed = error_types.agg(F.array_sort(F.collect_list(F.struct("error_type", "count"))))
    row = summary.withColumn("_types", packed.scalar()).withColumn(
        "_invalid", F.try_divide("invalid_items", "total_items")).withColumn(
        "_balance", F.try_divide("total_errors", "total_warnings"))
    frequent = F.transform(
        F.filter("_types", lambda e: e["count"] > F.col("total_items") * 0.05),
        lambda e: F.struct(F.lit("frequent_error").alias("code"), F.try_divide(e["count"], F.col("total_items")).alias("value"),
                           F.lit(0.05).alias("bound"), e["error_type"].alias("about")))
    return _rows(row, [
        _above("many_invalid", "_invalid", 0.1),
        _advice("errors_over_warnings", F.col("total_errors") > F.col("total_warnings") * 2, F.col("_balance"), 2),
    ], frequent)


def integration_recommendations(capture: DataFrame, routing: DataFrame, correlations: DataFrame) -> DataFrame:
    """From the capture stats row, the routing stats row and the tag correlations.

    All tags that users give and routing ignores are named, the most frequent first.
    """
    low = correlations.filter((F.col("correlation_rate") < 0.5) & (F.col("count") > 2))
    named = low.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "tag"))))
    row = (capture.withColumn("_r", routing.select(F.struct(*routing.columns)).scalar())
           .withColumn("_low", low.agg(F.count(F.lit(1))).scalar()).withColumn("_named", named.scalar()))
    return _rows(row, [
        _above("invalid_captures", "invalid_notes", 0),
        _below("few_tags", "avg_tags_per_note", 1),
        _advice("failed_routes", F.col("_r.success_rate") < 0.9, F.col("_r.success_rate"), 0.9),
        _advice("low_confidence", F.col("_r.avg_confidence") < 0.7, F.col("_r.avg_confidence"), 0.7),
        _advice("ignored_tags", F.col("_low") > 0, F.col("_low"), 0,
                F.array_join(F.transform("_named", lambda t: t["tag"]), ", ")),
    ])


def run_recommendations(row: DataFrame) -> DataFrame:
    """From one row with invalid, outliers, best_f1_score, brier_score_before/after, processing_time_ms."""
    gain = F.col("brier_score_before") - F.col("brier_score_after")
    return _rows(row, [
        _above("invalid_input", "invalid", 0), _above("outliers", "outliers", 0), _below("weak_model", "best_f1_score", 0.7),
        _advice("little_gain", gain < 0.01, gain, 0.01), _above("slow_run", "processing_time_ms", 100),
    ])


# --- alerts ----------------------------------------------------------------

def _alert_rows(metrics: DataFrame, alerts: list[tuple[str, str, float, str]]) -> DataFrame:
    """Adds type, value, bound and severity of each (type, column, bound, severity) that is exceeded; works on streams."""
    found = F.array_compact(F.array(*[
        F.when(F.col(column) > bound, F.struct(
            F.lit(kind).alias("type"), F.col(column).cast("double").alias("value"), F.lit(float(bound)).alias("bound"),
            F.lit(severity).alias("severity")))
        for kind, column, bound, severity in alerts]))
    return metrics.select("*", F.explode(found).alias("_a")).select("*", "_a.*").drop("_a")


def monitor_alerts(metrics: DataFrame, cpu_percent: float = 90.0, error_rate: float = 0.1) -> DataFrame:
    """Alerts per metrics row with cpu_percent and error_rate."""
    return _alert_rows(metrics, [("cpu", "cpu_percent", cpu_percent, "warning"), ("errors", "error_rate", error_rate, "critical")])


def performance_alerts(metrics: DataFrame, max_avg_time: float = 5.0, max_cpu: float = 80.0,
                       max_error_rate: float = 0.05) -> DataFrame:
    """Alerts per metrics row with average_time, cpu_average, error_rate."""
    return _alert_rows(metrics, [("time", "average_time", max_avg_time, "warning"), ("cpu", "cpu_average", max_cpu, "warning"),
                                 ("errors", "error_rate", max_error_rate, "critical")])
