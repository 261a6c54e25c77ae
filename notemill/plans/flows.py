"""The three end-to-end flows, and chains of user stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators import calibration as cal
from notemill.operators import evaluation as ev
from notemill.operators import notes as nt
from notemill.operators import observability as ob
from notemill.operators import recommendations as rec
from notemill.operators import routing as rt
from notemill.operators import validation as va
from notemill.operators.embedding import embed_hashed, tag_definition_vectors
from notemill.runtime import cut_lineage
from notemill.sources import writers as wr

Embed = Callable[[DataFrame], DataFrame]


# --- capture -> route -> analyse -------------------------------------------

def capture_and_route(lines: DataFrame, tags: DataFrame, embed: Embed = embed_hashed,
                      run_ts: str | None = None, top_k: int = rt.DEFAULT_TOP_K) -> DataFrame:
    """Parse capture lines, embed the bodies and route them; one narrow pass over the lines.

    ``lines`` needs (note_id, raw_text). An invalid line is still routed by its body.
    """
    index = rt.build_index(tag_definition_vectors(tags, embed))
    parsed = nt.parse_capture(lines, run_ts=run_ts)
    embedded = embed(parsed.withColumn("text", F.col("body"))).drop("text")
    return rt.route(embedded, index, top_k=top_k).drop("vector")


def integrated_rows(routed: DataFrame, tags: DataFrame, model: str = "hashed-tokens") -> DataFrame:
    """Nested result rows: what was captured, where it was routed, how."""
    full = rt.with_result_columns(routed, tags, model)
    failed = F.col("routed_tag") == "error"
    return full.select(
        "note_id",
        F.struct("tags", "body", "comment", "timestamp", "valid", "issues").alias("capture_data"),
        F.struct("routed_tag", "similarity_score", "confidence",
                 F.when(failed, "Routing failed").otherwise(F.col("tag_description")).alias("tag_description"),
                 F.coalesce("tag_examples", F.array().cast("array<string>")).alias("tag_examples"),
                 ).alias("routing"),
        F.struct(F.when(failed, "unknown").otherwise(F.lit(model)).alias("model_name"),
                 F.when(failed, "no vector").alias("error")).alias("integration_metadata"),
    )


def integration_outcomes(routed: DataFrame) -> DataFrame:
    """All sums behind the insights, per user tag, from one pass over the routed notes.

    Every note gives one row per distinct tag (one row with a NULL tag if it has
    none); its first row also carries the note's own counts. Written once.
    """
    ok = F.col("routed_tag") != "error"
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    rows = routed.select(
        F.posexplode_outer(F.array_distinct("tags")).alias("pos", "tag"), "routed_tag", "confidence",
        "similarity_score", ok.alias("ok"), F.col("valid"), F.size("tags").alias("n_tags"),
        (F.col("comment") != "").alias("commented"))
    first = F.coalesce("pos", F.lit(0)) == 0
    own = lambda c: F.sum(F.when(first, c).otherwise(0))
    return cut_lineage(rows.groupBy("tag").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("tag") == F.col("routed_tag")).alias("route_matches"),
        own(F.lit(1)).alias("notes"), own(flag(F.col("valid"))).alias("valid"),
        own((F.col("n_tags") > 0).cast("long")).alias("tagged"), own(flag(F.col("commented"))).alias("commented"),
        own(F.col("n_tags")).alias("n_tags"), own(flag(F.col("ok"))).alias("ok"),
        F.sum(F.when(first & F.col("ok"), F.col("confidence")).otherwise(0.0)).alias("confidence"),
        F.sum(F.when(first & F.col("ok"), F.col("similarity_score")).otherwise(0.0)).alias("similarity")))


def tag_correlations(sums: DataFrame) -> DataFrame:
    """Of each user tag, from ``integration_outcomes``: its notes, those routed to it, and their share."""
    return sums.filter(F.col("tag").isNotNull()).select(
        "tag", "count", "route_matches", (F.col("route_matches") / F.col("count")).alias("correlation_rate"))


def integration_insights(routed: DataFrame, sums: DataFrame | None = None, top_tags: int = 100) -> DataFrame:
    """One row: capture stats, routing stats, the ``top_tags`` most frequent user tags, recommendations.

    Users may give any number of tags: all of them are a table (``tag_correlations``), not a part of the row.
    """
    sums = integration_outcomes(routed) if sums is None else sums
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0)).cast("double")
    capture = sums.agg(
        total("notes").alias("total_notes"), total("valid").alias("valid_notes"),
        (total("notes") - total("valid")).alias("invalid_notes"), total("tagged").alias("notes_with_tags"),
        total("commented").alias("notes_with_comments"), ratio("n_tags", "notes").alias("avg_tags_per_note"))
    routes = sums.agg(
        total("notes").alias("total_routes"), total("ok").alias("successful_routes"),
        (total("notes") - total("ok")).alias("failed_routes"), ratio("ok", "notes").alias("success_rate"),
        ratio("confidence", "ok").alias("avg_confidence"), ratio("similarity", "ok").alias("avg_similarity"))
    corr = tag_correlations(sums)
    return routed.sparkSession.range(1).select(
        wr.pack_row(capture).alias("capture_stats"),
        wr.pack_row(routes).alias("routing_stats"),
        wr.pack(corr.orderBy(F.desc("count"), "tag").limit(top_tags)).alias("tag_correlations"),
        wr.messages(rec.integration_recommendations(capture, routes, corr)).alias("recommendations"),
    )


def _lines(layout: list[tuple[str, str, Column]], advice: str = "recommendations") -> Column:
    """Readable lines of (section, label, formatted value): a section's name stands before its first line."""
    out, before = [], None
    for section, label, value in layout:
        if section != before:
            out.append(F.lit(f"[{section}]"))
            before = section
        out.append(F.concat(F.lit(f"{label} = "), value))
    told = F.transform(advice, lambda r: F.concat(F.lit("- "), r))
    return F.array_join(F.concat(F.array(*out), F.array(F.lit("[advice]")), told), "\n")


def integration_summary(insights: DataFrame) -> DataFrame:
    """The insights as text lines."""
    c, r = F.col("capture_stats"), F.col("routing_stats")
    count = lambda v: F.format_string("%d", v)
    layout = [
        ("capture", "notes", count(c["total_notes"])), ("capture", "valid", count(c["valid_notes"])),
        ("capture", "invalid", count(c["invalid_notes"])), ("capture", "tags a note", F.format_string("%.2f", c["avg_tags_per_note"])),
        ("routing", "routed", count(r["successful_routes"])), ("routing", "failed", count(r["failed_routes"])),
        ("routing", "mean confidence", F.format_string("%.3f", r["avg_confidence"])),
    ]
    return insights.select(_lines(layout).alias("value"))


def save_integration(routed: DataFrame, tags: DataFrame, path: str) -> None:
    """Result rows, insights, all user tags and the summary under one folder; the notes are parsed, embedded and routed once."""
    routed = cut_lineage(routed)
    sums = integration_outcomes(routed)
    insights = cut_lineage(integration_insights(routed, sums))  # one row
    tag_correlations(sums).write.mode("overwrite").json(f"{path}/integration_tags")
    integrated_rows(routed, tags).write.mode("overwrite").json(f"{path}/integration_results")
    wr.write_report(insights, f"{path}/integration_insights")
    wr.write_lines(integration_summary(insights), f"{path}/integration_summary")


# --- library batch ---------------------------------------------------------

def library_batch(notes: DataFrame, tags: DataFrame, embed: Embed = embed_hashed, order_by: str = "note_id",
                  min_words: int = 3, max_words: int = 500) -> DataFrame:
    """De-duplicate, filter by length, embed and route already normalised notes."""
    index = rt.build_index(tag_definition_vectors(tags, embed))
    kept = nt.filter_by_length(notes, min_words, max_words)
    # the length depends on the text alone, so filtering before the shuffle keeps the same rows
    return rt.route(embed(nt.deduplicate_notes(kept, order_by)), index).drop("vector")


# --- full evaluation -------------------------------------------------------

def validation_report(checked: DataFrame) -> DataFrame:
    """One row: summary, error counts by type, recommendations. Details stay a table (``issue_rows``).

    One pass over the notes; the written table has one row per error type.
    """
    rows = checked.select(F.posexplode_outer("errors.error_type").alias("pos", "error_type"), "is_valid", "quality",
                          F.size("errors").alias("errors"), F.size("warnings").alias("warnings"))
    first = F.coalesce("pos", F.lit(0)) == 0
    own = lambda c: F.sum(F.when(first, c).otherwise(0))
    sums = cut_lineage(rows.groupBy("error_type").agg(
        F.count(F.lit(1)).alias("count"), own(F.lit(1)).alias("items"), own(F.col("is_valid").cast("long")).alias("valid"),
        own(F.col("quality")).alias("quality"), own(F.col("errors")).alias("errors"),
        own(F.col("warnings")).alias("warnings")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    summary = sums.agg(
        total("items").alias("total_items"), total("valid").alias("valid_items"),
        (total("items") - total("valid")).alias("invalid_items"),
        F.coalesce(F.try_divide(F.sum("valid"), F.sum("items")), F.lit(0.0)).alias("validation_rate"),
        F.bround(F.coalesce(F.try_divide(F.sum("quality"), F.sum("items")), F.lit(0.0)), 3).alias("average_quality_score"),
        total("errors").alias("total_errors"), total("warnings").alias("total_warnings"))
    types = sums.filter(F.col("error_type").isNotNull()).select("error_type", "count")
    return checked.sparkSession.range(1).select(
        wr.pack_row(summary).alias("summary"), wr.pack(types).alias("error_types"),
        wr.messages(rec.validation_recommendations(summary, types)).alias("recommendations"))


def evaluation_report(results: DataFrame, tags: DataFrame, time_ms: str | None = None) -> DataFrame:
    """One row: overall scores, per-tag scores, recommendations."""
    outcomes = ev.outcome_table(results, time_ms=time_ms)
    metrics = ev.metrics_from_outcomes(outcomes, tags)
    per_tag = ev.with_all_tags(ev.per_tag_metrics(ev.known_outcomes(outcomes, tags)), tags)
    return results.sparkSession.range(1).select(
        wr.pack_row(metrics).alias("summary"), wr.pack(per_tag).alias("per_tag_performance"),
        wr.messages(rec.evaluation_recommendations(metrics, per_tag)).alias("recommendations"))


def comparison_report(comparison: DataFrame) -> DataFrame:
    """One row: number of models, the best one, all of them by F1, recommendations."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("f1_score")).alias("neg_f1"), *comparison.columns)))
    base = comparison.agg(F.count(F.lit(1)).alias("total_models_evaluated"), ranked.alias("model_comparisons"))
    return base.select(
        "total_models_evaluated",
        F.get("model_comparisons", F.lit(0))["model_name"].alias("best_model"),
        F.coalesce(F.get("model_comparisons", F.lit(0))["f1_score"], F.lit(0.0)).alias("best_f1_score"),
        "model_comparisons",
        wr.messages(rec.model_recommendations(comparison)).alias("recommendations"))


def full_evaluation(notes: DataFrame, tags: DataFrame, results: DataFrame,
                    time_ms: str | None = None) -> DataFrame:
    """Validation, model comparison, calibration and advice in one report row.

    ``notes`` are the raw notes; ``results`` are routed labelled notes of every
    model under ``model_name``. The one eager step is the calibrator fit.
    """
    spark = notes.sparkSession
    checked = va.validate_notes(notes)
    quality = cut_lineage(va.input_summary(checked, va.detect_outliers(notes), "notes"))
    tag_quality = va.input_summary(va.validate_tags(tags), None, "tags")
    comparison = cut_lineage(ev.compare_models(results, tags, time_ms))  # one row per model
    best = ev.best_model(comparison).select("model_name")
    # three slim columns of the best model, written once for the fit and both reports
    data = cut_lineage(cal.calibration_dataset(results.filter(F.col("model_name") == best.scalar())).select(
        "note_id", "score", "correct"))
    calibrator = cal.fit_platt(data)
    scored = data.withColumn("calibrated", calibrator.predict(F.col("score")))
    gain = cal.calibration_report(data, calibrator)
    ece = cal.calibration_error(scored, "calibrated", "correct")
    mean_time = comparison.agg(F.coalesce(F.avg("processing_time_ms"), F.lit(0.0)))
    row = spark.range(1).select(
        wr.pack_row(quality).alias("note_quality"), wr.pack_row(tag_quality).alias("tag_quality"),
        wr.pack_row(comparison_report(comparison)).alias("model_performance"),
        wr.pack_row(gain).alias("calibration"), wr.pack_row(ece).alias("calibration_quality"),
        F.struct(F.lit(calibrator.intercept).alias("intercept"),
                 F.lit(calibrator.coefficient).alias("coefficient")).alias("calibrator"),
        mean_time.scalar().alias("processing_time_ms"))
    flat = row.select(
        F.col("note_quality.invalid").alias("invalid"), F.col("note_quality.outliers").alias("outliers"),
        F.col("model_performance.best_f1_score").alias("best_f1_score"),
        "calibration.brier_score_before", "calibration.brier_score_after", "processing_time_ms")
    return row.withColumn("recommendations", wr.messages(rec.run_recommendations(flat)))


def evaluation_summary(report: DataFrame) -> DataFrame:
    """The full report as text lines; the models as ``name f1 precision recall milliseconds``."""
    n, m = F.col("note_quality"), F.col("model_performance")
    models = F.array_join(F.transform(m["model_comparisons"], lambda x: F.format_string(
        "%s %.3f %.3f %.3f %.1f", x["model_name"], x["f1_score"], x["precision"], x["recall"], x["processing_time_ms"])), "; ")
    layout = [
        ("notes", "total", F.format_string("%d", n["total"])), ("notes", "valid", F.format_string("%d", n["valid"])),
        ("notes", "mean quality", F.format_string("%.3f", n["avg_quality_score"])),
        ("notes", "of unusual length", F.format_string("%d", n["outliers"])),
        ("tags", "total", F.format_string("%d", F.col("tag_quality")["total"])),
        ("models", "best", m["best_model"]), ("models", "best f1", F.format_string("%.3f", m["best_f1_score"])),
        ("models", "all", models),
        ("run", "milliseconds a note", F.format_string("%.1f", "processing_time_ms")),
    ]
    return report.select(_lines(layout).alias("value"))


def save_comparison(comparison: DataFrame, path: str) -> None:
    """Comparison report and best model as JSON."""
    comparison = cut_lineage(comparison)  # one row per model, read by both
    wr.write_report(comparison_report(comparison), f"{path}/model_comparison")
    wr.write_report(ev.best_model(comparison), f"{path}/best_model")


def save_full_evaluation(report: DataFrame, path: str) -> None:
    """The report row as JSON and as readable text."""
    report = cut_lineage(report)
    wr.write_report(report, f"{path}/comprehensive_evaluation_report")
    wr.write_lines(evaluation_summary(report), f"{path}/evaluation_summary")


# --- telemetry exports -----------------------------------------------------

def export_metrics(samples: DataFrame, path: str, order_by: list[str]) -> None:
    """Summary of the newest samples and the whole history, one dataset each."""
    samples = cut_lineage(samples)
    wr.write_sections({"summary": ob.recent_metrics_summary(samples, order_by), "history": samples}, path)


def export_errors(errors: DataFrame, now: Column, path: str, order_by: list[str]) -> None:
    """Counts, health, most common, newest and all errors, one dataset each.

    All errors are written first, typed; the other sections read that copy, so the source is read once.
    """
    errors = cut_lineage(errors)
    matrix = cut_lineage(ob.error_summary(errors))   # a row a type and component
    wr.write_sections({
        "all_errors": errors,
        "summary": matrix,
        "error_rate": ob.error_rate(errors, now),
        "component_health": ob.component_health(errors, now),
        "most_common_errors": ob.most_common_errors(errors),
        "recent_errors": ob.latest(errors, order_by),
    }, path)


# --- chains ----------------------------------------------------------------

def plugin_chain(df: DataFrame, plugins: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply DataFrame -> DataFrame plugins in order."""
    for plugin in plugins:
        df = df.transform(plugin)
    return df


@dataclass(frozen=True)
class Stage:
    """A named step; ``fails`` says (over its output) which rows do not pass."""

    name: str
    transform: Callable[[DataFrame], DataFrame]
    fails: Column


def run_stages(df: DataFrame, stages: list[Stage]) -> DataFrame:
    """Run stages in order and record the first one each row failed at.

    A failed row keeps flowing with ``failed_stage`` set, so the plan stays narrow.
    """
    out = df.withColumn("failed_stage", F.lit(None).cast("string"))
    for stage in stages:
        out = stage.transform(out).withColumn(
            "failed_stage",
            F.coalesce("failed_stage", F.when(F.coalesce(stage.fails, F.lit(False)), F.lit(stage.name))))
    return out.withColumn("success", F.col("failed_stage").isNull())
