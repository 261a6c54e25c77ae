"""Metrics against plain Python, splits, reports and flows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.operators import evaluation as ev
from notemill.operators import recommendations as rec
from notemill.operators import rules as ru
from notemill.plans import flows as fl
from notemill.sources import ontology as on
from notemill.sources import synth

TAGS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def results(spark):
    rng = np.random.default_rng(11)
    true = rng.choice([*TAGS[:3], "x"], 300, p=[0.5, 0.2, 0.2, 0.1])
    pred = np.where(rng.random(300) < 0.6, true, rng.choice([*TAGS[:3], "y"], 300))
    rows = [(i, str(t), str(p), float(c), float(i % 5)) for i, (t, p, c) in enumerate(zip(true, pred, rng.random(300)))]
    return spark.createDataFrame(rows, "note_id int, true_tag string, routed_tag string, confidence double, ms double")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([(t,) for t in TAGS], "tag string")


def _expected(rows):
    rows = [r for r in rows if r["true_tag"] in TAGS and r["routed_tag"] in TAGS]
    per = {}
    for t in TAGS:
        tp = sum(r["true_tag"] == r["routed_tag"] == t for r in rows)
        called, support = sum(r["routed_tag"] == t for r in rows), sum(r["true_tag"] == t for r in rows)
        p, q = (tp / called if called else 0.0), (tp / support if support else 0.0)
        per[t] = (p, q, 2 * p * q / (p + q) if p + q else 0.0, support)
    n = len(rows)
    weighted = [sum(v[i] * v[3] for v in per.values()) / n for i in range(3)]
    hit = np.array([r["true_tag"] == r["routed_tag"] for r in rows], float)
    corr = np.corrcoef([r["confidence"] for r in rows], hit)[0, 1]
    return per, weighted, hit.mean(), corr, n


def test_evaluate(results, tags):
    rows = results.collect()
    per, weighted, accuracy, corr, n = _expected(rows)
    got = ev.evaluate(results, tags, time_ms="ms").first()
    assert [got["precision"], got["recall"], got["f1_score"]] == pytest.approx(weighted)
    assert got["accuracy"] == pytest.approx(accuracy) and got["n"] == n
    assert got["confidence_correlation"] == pytest.approx(corr)
    assert got["processing_time_ms"] == pytest.approx(2.0)
    known = ev.known_outcomes(ev.confusion_counts(results), tags)
    table = {r["tag"]: (r["precision"], r["recall"], r["f1_score"], r["support"])
             for r in ev.with_all_tags(ev.per_tag_metrics(known), tags).collect()}
    for tag in TAGS:
        assert table[tag] == pytest.approx(per[tag])
    matrix = ev.confusion_matrix(known, tags).collect()
    assert len(matrix) == 16 and sum(r["n"] for r in matrix) == n
    outside = {r["routed_tag"] for r in rows} - set(TAGS)
    assert {r["routed_tag"] for r in ev.unknown_tags(results, tags).collect()} == outside
    assert ev.keep_known_tags(results, tags).count() == n


def test_constant_confidence_has_no_correlation(results, tags):
    flat = results.withColumn("confidence", F.lit(0.5))
    assert ev.evaluate(flat, tags).first()["confidence_correlation"] == 0.0


def test_folds_are_balanced(results):
    folded = ev.stratified_folds(results, "true_tag", "note_id", 5)
    sizes = folded.groupBy("true_tag", "fold").count().groupBy("true_tag").agg(
        (F.max("count") - F.min("count")).alias("gap"), F.count("*").alias("folds")).collect()
    assert all(r["gap"] <= 1 and r["folds"] == 5 for r in sizes) and folded.count() == 300
    split = ev.stratified_split(results, "true_tag", "note_id").groupBy("true_tag").agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_train")).alias("v")).collect()
    assert all(r["v"] == -(-r["n"] * 2 // 10) for r in split)


def test_models(spark, results, tags):
    union = ev.union_models({
        "all-mpnet-base-v2": results.withColumn("embedding_dimension", F.lit(768)),
        "other": results.filter("note_id < 200").withColumn("embedding_dimension", F.lit(10 ** 9))})
    table = {r["model_name"]: r for r in ev.compare_models(union, tags, "ms").collect()}
    assert table["all-mpnet-base-v2"]["model_size_mb"] == 420.0 and table["other"]["model_size_mb"] == 200.0
    assert table["all-mpnet-base-v2"]["memory_usage_mb"] == pytest.approx(768 * 4000 / 2 ** 20)
    assert table["other"]["memory_usage_mb"] == 1000.0
    comparison = spark.createDataFrame(
        [("a", 0.90, 0.5, 0.5, 100.0, 600.0), ("b", 0.88, 0.9, 0.5, 60.0, 700.0)],
        "model_name string, f1_score double, precision double, recall double, processing_time_ms double, memory_usage_mb double")
    pick = lambda c: ev.best_model(comparison, c).first()["model_name"]
    assert [pick(c) for c in ("f1_score", "precision", "recall", "speed")] == ["a", "b", "a", "b"]
    with pytest.raises(ValueError):
        ev.best_model(comparison, "beauty")
    advice = rec.model_recommendations(comparison).orderBy("position").collect()
    assert [(r["code"], r["about"]) for r in advice] == [
        ("all_models_slow", None), ("all_models_large", None), ("strong_model", "a"), ("bargain_model", "b")]
    assert advice[0]["value"] == 60.0 and advice[0]["bound"] == 50.0 and advice[3]["recommendation"].endswith(": b")
    assert ev.model_tradeoff(comparison).first()["prefer_second"]
    none = rec.model_recommendations(comparison.limit(0)).collect()
    assert [r["code"] for r in none] == ["no_model"]


def test_rules(spark):
    df = spark.createDataFrame([(1, "research", 0.8, 5), (2, "work", 0.9, 20000), (3, None, None, None)],
                               "id int, category string, confidence_score double, content_length int")
    rules = [
        ru.Rule("research_routing", [ru.Condition("category", "equals", "research"),
                                     ru.Condition("confidence_score", "greater_than", 0.7)], "research_storage", 1),
        ru.Rule("large", [ru.Condition("content_length", "greater_than", 10000)], "batch_processor", 2),
    ]
    got = [r["destination"] for r in ru.apply_rules(df, rules).orderBy("id").collect()]
    assert got == ["research_storage", "batch_processor", "default"]
    shares = spark.range(20000).select(ru.weighted_destination(F.col("id"), [("a", 3.0), ("b", 1.0)]).alias("d"))
    assert shares.filter("d = 'a'").count() / 20000 == pytest.approx(0.75, abs=0.02)


def test_flows(spark, tmp_path):
    tags = on.default_tags(spark)
    lines = spark.createDataFrame(
        [(1, "#todo_item need to fix the authentication bug //soon @2025-01-27T10:30:00"), (2, "#x"), (3, "plain note text")],
        "note_id int, raw_text string")
    routed = fl.capture_and_route(lines, tags, run_ts="2025-01-31T00:00:00")
    row = {r["note_id"]: r for r in routed.collect()}
    assert row[1]["routed_tag"] == "todo_item" and not row[2]["valid"]
    insights = fl.integration_insights(routed).first()
    assert insights["capture_stats"]["total_notes"] == 3 and insights["capture_stats"]["notes_with_tags"] == 2
    assert insights["routing_stats"]["success_rate"] == 1.0 and len(insights["tag_correlations"]) == 2
    assert insights["recommendations"][0] == rec.SENTENCES["invalid_captures"]
    fl.save_integration(routed, tags, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/integration_results").count() == 3
    assert spark.read.text(f"{tmp_path}/out/integration_summary").first()[0] == "[capture]"
    notes = synth.generate_notes(spark, 80)
    batch = fl.library_batch(notes, tags)
    assert 0 < batch.count() <= 80 and batch.select("text").distinct().count() == batch.count()


def test_stages(spark):
    df = spark.createDataFrame([("",), ("ok",), (None,)], "text string")
    stages = [fl.Stage("present", lambda d: d, F.col("text").isNull()), fl.Stage("filled", lambda d: d, F.col("text") == "")]
    assert [r["failed_stage"] for r in fl.run_stages(df, stages).collect()] == ["filled", None, "present"]
