"""Registered queries over reports: written by the flows, read back and compared field by field."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.operators import calibration as cal
from notemill.operators import recommendations as rec
from notemill.operators import validation as va
from notemill.plans import flows as fl
from notemill.plans import inputs as inp
from notemill.plans import queries_eval as qe
from notemill.plans import queries_vectors as qv
from notemill.runtime import cut_lineage, scratch_path
from notemill.sources import ontology as on
from notemill.sources import writers as wr

QUERIES = {}
ORACLE = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def _fields(row, prefix: str, names: dict):
    """A report's values as (section, key, value) rows."""
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(prefix).alias("section"), F.lit(key).alias("key"), F.round(F.col(c).cast("double"), 4).alias("value"))
        for key, c in names.items()])).alias("f")).select("f.*")


def _read(spark, path, like):
    return spark.read.schema(like.schema).json(path)


@_query("saved_integration", f"""WITH {qv._SQL_CAPTURE_ROUTED},
c AS (SELECT count(*) AS total, count(*) FILTER (valid) AS valid, avg(len(tags)) AS tags FROM checked),
r AS (SELECT avg(conf) AS conf, avg(sim) AS sim FROM best),
u AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM checked) GROUP BY 1)
SELECT 'rows' AS section, routed_tag AS key, count(*)::DOUBLE AS value FROM best GROUP BY 2
UNION ALL SELECT 'capture', 'total', total FROM c UNION ALL SELECT 'capture', 'valid', valid FROM c
UNION ALL SELECT 'capture', 'tags', round(tags, 4) FROM c UNION ALL SELECT 'routing', 'confidence', round(conf, 4) FROM r
UNION ALL SELECT 'routing', 'similarity', round(sim, 4) FROM r UNION ALL SELECT 'tags', tag, n FROM u
UNION ALL SELECT 'summary', 'notes = ' || total, 1 FROM c""")
def saved_integration(spark, sf):
    path = scratch_path(spark, "integration")
    tags = on.default_tags(spark)
    routed = cut_lineage(qv._captured(spark, sf))
    fl.save_integration(routed, tags, path)
    rows = _read(spark, f"{path}/integration_results", fl.integrated_rows(routed, tags))
    insights = _read(spark, f"{path}/integration_insights", fl.integration_insights(routed))
    lines = spark.read.text(f"{path}/integration_summary")
    count = F.count(F.lit(1)).cast("double").alias("value")
    return (
        rows.groupBy(F.lit("rows").alias("section"), F.col("routing.routed_tag").alias("key")).agg(count)
        .unionByName(_fields(insights, "capture", {
            "total": "capture_stats.total_notes", "valid": "capture_stats.valid_notes", "tags": "capture_stats.avg_tags_per_note"}))
        .unionByName(_fields(insights, "routing", {
            "confidence": "routing_stats.avg_confidence", "similarity": "routing_stats.avg_similarity"}))
        .unionByName(spark.read.schema("tag string, count bigint").json(f"{path}/integration_tags").select(
            F.lit("tags").alias("section"), F.col("tag").alias("key"), F.col("count").cast("double").alias("value")))
        .unionByName(lines.filter(F.startswith("value", F.lit("notes = "))).groupBy(F.lit("summary").alias("section"), F.col("value").alias("key")).agg(count)))


@_query("saved_evaluation", f"""{qe._KNOWN_ROUTED}
SELECT 'summary' AS section, 'precision' AS key, round(precision, 4) AS value FROM wm UNION ALL SELECT 'summary', 'recall', round(recall, 4) FROM wm
UNION ALL SELECT 'summary', 'f1', round(f1_score, 4) FROM wm UNION ALL SELECT 'summary', 'n', n FROM wm
UNION ALL SELECT 'tag', tag, round(f1_score, 4) FROM m""")
def saved_evaluation(spark, sf):
    path = scratch_path(spark, "evaluation")
    report = fl.evaluation_report(qe._routed(spark, sf), qe._known_tags(spark), "time_ms")
    wr.write_report(report, path)
    back = _read(spark, path, report)
    return _fields(back, "summary", {"precision": "summary.precision", "recall": "summary.recall", "f1": "summary.f1_score", "n": "summary.n"}).unionByName(
        back.select(F.explode("per_tag_performance").alias("t")).select(
            F.lit("tag").alias("section"), F.col("t.tag").alias("key"), F.round("t.f1_score", 4).alias("value")))


@_query("saved_comparison", f"""{qe._CMP}
SELECT 'model' AS section, model_name AS key, round(f1_score, 4) AS value FROM cmp
UNION ALL (SELECT 'best', model_name, round(f1_score, 4) FROM cmp ORDER BY cmp.f1_score DESC, model_name LIMIT 1)
UNION ALL (SELECT 'best_file', model_name, round(processing_time_ms, 4) FROM cmp ORDER BY cmp.f1_score DESC, model_name LIMIT 1)
UNION ALL SELECT 'total', 'models', count(*) FROM cmp""")
def saved_comparison(spark, sf):
    path = scratch_path(spark, "comparison")
    comparison = cut_lineage(qe._comparison(spark, sf))
    fl.save_comparison(comparison, path)
    report = _read(spark, f"{path}/model_comparison", fl.comparison_report(comparison))
    best = _read(spark, f"{path}/best_model", comparison)
    row = lambda df, section, key, value: df.select(
        F.lit(section).alias("section"), key.alias("key"), F.round(F.col(value).cast("double"), 4).alias("value"))
    return (row(report.select(F.explode("model_comparisons").alias("m")), "model", F.col("m.model_name"), "m.f1_score")
            .unionByName(row(report, "best", F.col("best_model"), "best_f1_score"))
            .unionByName(row(best, "best_file", F.col("model_name"), "processing_time_ms"))
            .unionByName(row(report, "total", F.lit("models"), "total_models_evaluated")))


@_query("saved_validation", f"""WITH {inp.SQL_CHECKED_NOTES}
SELECT 'summary' AS section, 'total' AS key, count(*)::DOUBLE AS value FROM checked_notes
UNION ALL SELECT 'summary', 'valid', count(*) FILTER (is_valid) FROM checked_notes
UNION ALL SELECT 'summary', 'errors', sum(len(errors)) FROM checked_notes UNION ALL SELECT 'summary', 'warnings', sum(len(warnings)) FROM checked_notes
UNION ALL SELECT 'type', e, count(*) FROM (SELECT unnest(errors) AS e FROM checked_notes) GROUP BY 2""")
def saved_validation(spark, sf):
    path = scratch_path(spark, "validation")
    report = fl.validation_report(va.validate_notes(inp.raw_notes(spark, sf)))
    wr.write_report(report, path)
    back = _read(spark, path, report)
    return _fields(back, "summary", {"total": "summary.total_items", "valid": "summary.valid_items", "errors": "summary.total_errors",
                                     "warnings": "summary.total_warnings"}).unionByName(
        back.select(F.explode("error_types").alias("t")).select(
            F.lit("type").alias("section"), F.col("t.error_type").alias("key"), F.col("t.count").cast("double").alias("value")))


def _full_report(spark, sf):
    known = qe._known_tags(spark).withColumn("description", F.lit("a label of the table")).withColumn(
        "examples", F.array(F.lit("example text"))).withColumn("confidence_threshold", F.lit(0.3))
    tags = on.default_tags(spark).select("tag", "description", "examples", "confidence_threshold").unionByName(known)
    return fl.full_evaluation(inp.raw_notes(spark, sf), tags, qe._model_results(spark, sf), "time_ms")


_OUTLIERS = f"""(WITH {inp.SQL_NOTES}, s AS (SELECT avg(length(text)) AS mean, stddev_pop(length(text)) AS std FROM notes)
  SELECT count(*) FROM notes, s WHERE abs(length(text) - mean) > 2 * std)"""


@_query("full_evaluation", f"""{qe._CMP},
best AS (SELECT model_name, f1_score FROM cmp ORDER BY f1_score DESC, model_name LIMIT 1),
q AS (WITH {inp.SQL_CHECKED_NOTES} SELECT count(*) AS total, count(*) FILTER (is_valid) AS valid, avg(quality) AS quality FROM checked_notes)
SELECT 'notes' AS section, 'total' AS key, total::DOUBLE AS value FROM q UNION ALL SELECT 'notes', 'valid', valid FROM q
UNION ALL SELECT 'notes', 'quality', round(quality, 4) FROM q UNION ALL SELECT 'notes', 'outliers', {_OUTLIERS}
UNION ALL SELECT 'tags', 'total', 16 UNION ALL SELECT 'models', 'best_f1', round(f1_score, 4) FROM best
UNION ALL SELECT 'models', 'total', count(*) FROM cmp UNION ALL SELECT 'models', 'time', round(avg(processing_time_ms), 4) FROM cmp
UNION ALL SELECT 'text', 'best = ' || model_name, 1 FROM best""")
def full_evaluation(spark, sf):
    """The whole evaluation run, saved as report and text."""
    path = scratch_path(spark, "full_evaluation")
    report = cut_lineage(_full_report(spark, sf))
    fl.save_full_evaluation(report, path)
    back = _read(spark, f"{path}/comprehensive_evaluation_report", report)
    lines = spark.read.text(f"{path}/evaluation_summary").filter(F.startswith("value", F.lit("best = ")))
    return (_fields(back, "notes", {"total": "note_quality.total", "valid": "note_quality.valid", "quality": "note_quality.avg_quality_score",
                                    "outliers": "note_quality.outliers"})
            .unionByName(_fields(back, "tags", {"total": "tag_quality.total"}))
            .unionByName(_fields(back, "models", {"best_f1": "model_performance.best_f1_score", "total": "model_performance.total_models_evaluated",
                                                  "time": "processing_time_ms"}))
            .unionByName(lines.groupBy(F.lit("text").alias("section"), F.col("value").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))))


@_query("run_recommendations", f"""WITH v AS (SELECT
  (WITH {inp.SQL_CHECKED_NOTES} SELECT count(*) FILTER (NOT is_valid) FROM checked_notes) AS invalid, {_OUTLIERS} AS outliers,
  ({qe._CMP} SELECT max(f1_score) FROM cmp) AS f1, ({qe._CMP} SELECT avg(processing_time_ms) FROM cmp) AS t,
  ({qe._PLATT}, p AS (SELECT s, y, 1 / (1 + exp(-(a * s + b))) AS p FROM scored, fit)
   SELECT avg((s - y) * (s - y)) - avg((p - y) * (p - y)) FROM p) AS gain)
SELECT 'invalid_input' AS code, invalid::DOUBLE AS value FROM v WHERE invalid > 0 UNION ALL SELECT 'outliers', outliers FROM v WHERE outliers > 0
UNION ALL SELECT 'weak_model', round(f1, 4) FROM v WHERE f1 < 0.7 UNION ALL SELECT 'little_gain', round(gain, 4) FROM v WHERE gain < 0.01
UNION ALL SELECT 'slow_run', round(t, 4) FROM v WHERE t > 100""")
def run_recommendations(spark, sf):
    """From the validated notes, the compared models and the fitted calibrator."""
    notes = inp.raw_notes(spark, sf)
    quality = va.input_summary(va.validate_notes(notes), va.detect_outliers(notes), "notes")
    comparison = qe._comparison(spark, sf)
    data = cut_lineage(qe._scored(spark, sf).select("note_id", "score", "correct"))
    gain = cal.calibration_report(data, cal.fit_platt(data))
    row = (quality.select("invalid", "outliers")
           .withColumn("_m", comparison.agg(F.struct(F.max("f1_score").alias("best_f1_score"), F.avg("processing_time_ms").alias("processing_time_ms"))).scalar())
           .withColumn("_g", gain.select(F.struct("brier_score_before", "brier_score_after")).scalar())
           .select("invalid", "outliers", "_m.*", "_g.*"))
    return rec.run_recommendations(row).select("code", F.round("value", 4).alias("value"))


