"""Event builders, windows of now, exports."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notemill.operators import evaluation as ev
from notemill.operators import observability as ob
from notemill.operators import recommendations as rec
from notemill.operators import rules as ru
from notemill.plans import flows as fl
from notemill.sources import writers as wr

NOW = datetime(2024, 1, 1, 12, 0, 0)


@pytest.fixture(scope="module")
def errors(spark):
    rows = [(datetime(2024, 1, 1, 11, m), "router", "io") for m in (0, 10, 20, 30, 40)]
    rows += [(datetime(2024, 1, 1, 10, 59, 59), "embedder", "io"), (datetime(2024, 1, 1, 12, 0), "parser", None)]
    return spark.createDataFrame(rows, "timestamp timestamp, component string, error_type string")


def test_builders(spark):
    runs = spark.createDataFrame([(NOW, "m", 2.5, 10, {"f1": 0.5})],
                                 "timestamp timestamp, model_name string, training_time_seconds double, num_samples int, metrics map<string,double>")
    row = ob.training_events(runs).first()
    assert row["message"] == "Trained model m on 10 samples"
    assert row["performance_metrics"] == {"training_time_seconds": 2.5, "f1": 0.5}
    timings = spark.createDataFrame([(NOW, "c", "op", 1.234, 0.0), (NOW, "c", "op", 2.0, 8.0)],
                                    "timestamp timestamp, component string, operation string, duration_ms double, memory_usage_mb double")
    first, second = ob.performance_events(timings).orderBy(F.col("performance_metrics")["duration_ms"]).collect()
    assert first["performance_metrics"] == {"duration_ms": 1.234} and first["message"] == "op completed in 1.23ms"
    assert second["performance_metrics"] == {"duration_ms": 2.0, "memory_usage_mb": 8.0}
    summary = {r["metric"]: r["count"] for r in ob.metric_summary(ob.performance_events(timings)).collect()}
    assert summary == {"duration_ms": 2, "memory_usage_mb": 1}


def test_health_and_rates(errors):
    now = F.lit(NOW)
    health = {r["component"]: r["status"] for r in ob.component_health(errors, now).collect()}
    assert health == {"router": "critical", "embedder": "healthy", "parser": "warning"}
    assert ob.error_rate(errors, now).first()["error_rate"] == pytest.approx(6 / 3600)
    assert {r["error_type"]: r["count"] for r in ob.error_counts(errors).collect()} == {"io": 6, "unknown": 1}
    assert ob.most_common_errors(errors, 1).first()["error_type"] == "io"


def test_alerts(spark):
    m = spark.createDataFrame([(95.0, 0.2), (90.0, 0.1)], "cpu_percent double, error_rate double")
    assert [(r["type"], r["value"], r["bound"]) for r in rec.monitor_alerts(m).collect()] == [("cpu", 95.0, 90.0), ("errors", 0.2, 0.1)]


def test_length_batches(spark):
    df = spark.createDataFrame([("x" * n,) for n in (600, 5, 99, 100, 500)], "text string").coalesce(1)
    rows = ru.batch_by_length(df).collect()
    assert [r["length_bucket"] for r in rows] == ["short", "short", "medium", "long", "long"]


def test_exports(spark, errors, tmp_path):
    fl.export_errors(errors, F.lit(NOW), f"{tmp_path}/e", ["timestamp"])
    assert spark.read.json(f"{tmp_path}/e/all_errors").count() == 7
    assert spark.read.json(f"{tmp_path}/e/component_health").count() == 3
    samples = errors.select("timestamp", *[F.lit(1.0).alias(m) for m in ob.METRICS])
    fl.export_metrics(samples, f"{tmp_path}/m", ["timestamp"])
    assert spark.read.json(f"{tmp_path}/m/summary").count() == 5
    assert wr.read_section(spark, f"{tmp_path}/m", "history").schema["timestamp"].dataType == samples.schema["timestamp"].dataType
    with pytest.raises(Exception):
        wr.read_section(spark, f"{tmp_path}/absent", "history")   # an export that did not end has no list
    comparison = spark.createDataFrame(
        [("a", 0.9, 1.0, 1.0, 10.0, 1.0)],
        "model_name string, f1_score double, precision double, recall double, processing_time_ms double, memory_usage_mb double")
    fl.save_comparison(comparison, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/c/best_model").first()["model_name"] == "a"
    assert ev.rank_models(comparison).count() == 1
