"""Operational events: builders, summaries, health and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notemill.operators.ordering import exact_ranks, null_safe_join, trailing_rows_average, trailing_time_count

METRICS = ("cpu_percent", "memory_mb", "processing_time_ms", "throughput_notes_per_second", "error_rate")
_ERROR = "struct<error_type:string,stack_trace:string>"


# --- event builders --------------------------------------------------------

def _event(df: DataFrame, ts: Column, event_type: str, component: Column, message: Column,
           metadata: Column, metrics: Column | None = None, error: Column | None = None) -> DataFrame:
    return df.select(
        ts.alias("timestamp"), F.lit(event_type).alias("event_type"), component.alias("component"),
        message.alias("message"), metadata.cast("map<string,string>").alias("metadata"),
        (metrics if metrics is not None else F.lit(None)).cast("map<string,double>").alias("performance_metrics"),
        (error if error is not None else F.lit(None)).cast(_ERROR).alias("error_details"),
    )


def _map(**columns: Column) -> Column:
    """Map of the non-NULL entries."""
    entries = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c)])
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def prediction_events(routed: DataFrame, ts: str = "timestamp", model: str = "hashed-tokens") -> DataFrame:
    return _event(
        routed, F.col(ts), "prediction", F.lit("router"),
        F.concat(F.lit("Predicted tag '"), "routed_tag", F.lit("' for note "), F.col("note_id").cast("string")),
        _map(note_id=F.col("note_id").cast("string"), predicted_tag=F.col("routed_tag"), model_name=F.lit(model)),
        _map(confidence=F.col("confidence"), processing_time_ms=F.col("processing_time_ms").cast("double"),
             similarity_score=F.col("similarity_score")),
    )


def training_events(runs: DataFrame) -> DataFrame:
    """From (timestamp, model_name, training_time_seconds, num_samples, metrics map)."""
    return _event(
        runs, F.col("timestamp"), "training", F.lit("evaluator"),
        F.format_string("Trained model %s on %d samples", "model_name", "num_samples"),
        _map(model_name=F.col("model_name"), num_samples=F.col("num_samples").cast("string")),
        F.map_concat(_map(training_time_seconds=F.col("training_time_seconds").cast("double")), F.col("metrics")),
    )


def error_events(errors: DataFrame) -> DataFrame:
    """From (timestamp, component, message, error_type, stack_trace, context map)."""
    return _event(
        errors, F.col("timestamp"), "error", F.col("component"), F.col("message"),
        F.coalesce("context", F.create_map().cast("map<string,string>")),
        error=F.struct(F.col("error_type"), F.col("stack_trace")),
    )


def performance_events(timings: DataFrame) -> DataFrame:
    """From (timestamp, component, operation, duration_ms, memory_usage_mb); zero memory is left out."""
    return _event(
        timings, F.col("timestamp"), "performance", F.col("component"),
        F.format_string("%s completed in %.2fms", "operation", "duration_ms"),
        _map(operation=F.col("operation")),
        _map(duration_ms=F.col("duration_ms"),
             memory_usage_mb=F.when(F.col("memory_usage_mb") != 0, F.col("memory_usage_mb"))),
    )


def events_between(events: DataFrame, start, end, ts: str = "timestamp") -> DataFrame:
    """Events with start <= ts <= end; an open bound is None."""
    if start is not None:
        events = events.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        events = events.filter(F.col(ts) <= F.lit(end))
    return events


# --- summaries -------------------------------------------------------------

def metric_summary(events: DataFrame) -> DataFrame:
    """Mean, min, max and count per metric name."""
    exploded = events.select(F.explode("performance_metrics").alias("metric", "value"))
    return exploded.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count(F.lit(1)).alias("count"))


def error_counts(errors: DataFrame, error_type: str = "error_type") -> DataFrame:
    return errors.groupBy(F.coalesce(error_type, F.lit("unknown")).alias("error_type")).agg(
        F.count(F.lit(1)).alias("count"))


def recent_metrics_summary(samples: DataFrame, order_by: list[str], n: int = 100) -> DataFrame:
    """Mean, max and min of the five metrics over the newest ``n`` samples (a top-n, not a full sort)."""
    recent = samples.orderBy(*[F.desc(c) for c in order_by]).limit(n)
    rows = recent.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS
    ])).alias("m")).select("m.*")
    return rows.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"))


def processing_totals(events: DataFrame, is_error: Column) -> DataFrame:
    return events.agg(F.count_if(~is_error).alias("total_notes_processed"), F.count_if(is_error).alias("total_errors"))


def collect_metrics(events: DataFrame, value: str, ts: str, order_by: list[str], is_error: Column,
                    last: int = 100) -> DataFrame:
    """Mean of the newest times, throughput over the observed span and error rate, in one row."""
    recent = events.filter(~is_error).orderBy(*[F.desc(c) for c in order_by]).limit(last).agg(
        F.coalesce(F.avg(value), F.lit(0.0)))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seconds = (F.max(micros) - F.min(micros)) / F.lit(1e6)
    done, failed = F.count_if(~is_error), F.count_if(is_error)
    return events.agg(
        F.coalesce(F.try_divide(done, seconds), F.lit(0.0)).alias("throughput_notes_per_second"),
        F.coalesce(F.try_divide(failed, done), F.lit(0.0)).alias("error_rate"),
    ).withColumn("processing_time_ms", recent.scalar())


def error_summary(errors: DataFrame) -> DataFrame:
    """Counts in total, by type and by component in one scan; the level says which."""
    grouped = errors.groupingSets(
        [[F.col("error_type")], [F.col("component")], []], F.col("error_type"), F.col("component")
    ).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 1, "type").when(F.col("_g") == 2, "component").otherwise("total")
    return grouped.select(level.alias("level"), F.coalesce("error_type", "component", F.lit("all")).alias("key"),
                          "count")


def error_matrix(errors: DataFrame, now: Column, window_seconds: int = 3600) -> DataFrame:
    """By type and by (component, type), in total and within the last hour before ``now``."""
    recent = F.col("timestamp") > now - F.make_dt_interval(secs=F.lit(window_seconds))
    return errors.groupingSets(
        [[F.col("component"), F.col("error_type")], [F.col("error_type")], []],
        F.col("component"), F.col("error_type"),
    ).agg(F.count(F.lit(1)).alias("count"), F.count_if(recent).alias("recent")).select(
        F.coalesce("component", F.lit("all")).alias("component"),
        F.coalesce("error_type", F.lit("all")).alias("error_type"), "count", "recent")


def latest(events: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    return events.orderBy(*[F.desc(c) for c in order_by]).limit(n)


def most_common_errors(errors: DataFrame, top_n: int = 5) -> DataFrame:
    return error_counts(errors).orderBy(F.desc("count"), "error_type").limit(top_n)


def error_rate(errors: DataFrame, now: Column, window_seconds: int = 3600, ts: str = "timestamp") -> DataFrame:
    """Errors per second in the window that ends at ``now`` (bounds included)."""
    start = now - F.make_dt_interval(secs=F.lit(window_seconds))
    inside = F.col(ts).between(start, now)
    return errors.agg((F.count_if(inside) / F.lit(float(window_seconds))).alias("error_rate"))


def component_health(errors: DataFrame, now: Column, window_seconds: int = 3600, ts: str = "timestamp") -> DataFrame:
    """Per component: all errors, those of the last hour, and healthy / warning / critical."""
    start = now - F.make_dt_interval(secs=F.lit(window_seconds))
    counted = errors.groupBy("component").agg(
        F.count(F.lit(1)).alias("total_errors"), F.count_if(F.col(ts).between(start, now)).alias("recent_errors"))
    return counted.withColumn("status", health_status(F.col("recent_errors")))


def health_status(recent: Column) -> Column:
    return F.when(recent == 0, "healthy").when(recent < 5, "warning").otherwise("critical")


def trailing_average(events: DataFrame, component: str, order_by: list[str], value: str, n: int = 100) -> DataFrame:
    return trailing_rows_average(events, component, order_by, value, n, "trailing_avg")


def trailing_error_rate(errors: DataFrame, component: str, ts: str, window_seconds: int = 3600) -> DataFrame:
    counted = trailing_time_count(errors, component, ts, window_seconds, "errors_in_window")
    return counted.withColumn("error_rate", F.col("errors_in_window") / F.lit(float(window_seconds)))


def latency_summary(events: DataFrame, operation: str, value: str) -> DataFrame:
    """Exact median, p95 and p99 as ``sorted[int(q * n)]``, with mean, min and max."""
    n = F.col("n")
    ranks = exact_ranks(events, operation, value, {
        "median_time": F.floor(n / 2),
        "p95_time": F.floor(n * F.lit(0.95)),
        "p99_time": F.floor(n * F.lit(0.99)),
    })
    basic = events.groupBy(operation).agg(
        F.avg(value).alias("average_time"), F.min(value).alias("min_time"), F.max(value).alias("max_time"))
    return null_safe_join(ranks.withColumnRenamed("n", "total_processed"), basic, [operation])


def latency_summary_approx(events: DataFrame, operation: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Same measures from mergeable sketches: one aggregate and no sort, approximate ranks."""
    q = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), accuracy)
    return events.groupBy(operation).agg(
        F.count(value).alias("total_processed"), F.avg(value).alias("average_time"), q.alias("_q"),
        F.min(value).alias("min_time"), F.max(value).alias("max_time"),
    ).select(operation, "total_processed", "average_time", F.col("_q")[0].alias("median_time"),
             F.col("_q")[1].alias("p95_time"), F.col("_q")[2].alias("p99_time"), "min_time", "max_time")


def operation_summary(events: DataFrame, operation: str, duration: str, success: Column) -> DataFrame:
    return events.groupBy(operation).agg(
        F.avg(duration).alias("average_time"), F.avg(success.cast("double")).alias("success_rate"),
        F.count(F.lit(1)).alias("total_operations"))


def batch_summary(items: DataFrame, batch: str, success: Column, duration: str) -> DataFrame:
    return items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(success).alias("successful"),
        F.count_if(~success).alias("failed"), F.sum(duration).alias("processing_time"))


def ingestion_metrics(notes: DataFrame, source_type: str, text: str, valid: Column) -> DataFrame:
    return notes.groupBy(source_type).agg(
        F.count(F.lit(1)).alias("volume"), F.sum(F.length(text)).alias("total_size"),
        F.count_if(valid).alias("success_count"), F.count_if(~valid).alias("error_count"))


def routing_stats(routed: DataFrame) -> DataFrame:
    """Totals and rate over all routes, mean confidence and similarity over the successful ones."""
    ok = F.col("routed_tag") != "error"
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))
    return routed.agg(
        F.count(F.lit(1)).alias("total_routes"),
        F.count_if(ok).alias("successful_routes"),
        F.count_if(~ok).alias("failed_routes"),
        F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("success_rate"),
        mean("confidence").alias("avg_confidence"),
        mean("similarity_score").alias("avg_similarity"),
    )


def tag_distribution(routed: DataFrame, tag: str = "routed_tag") -> DataFrame:
    return routed.groupBy(tag).agg(F.count(F.lit(1)).alias("count"))


def destination_metrics(decisions: DataFrame, destination: str, duration: str, correct: Column,
                        error: Column) -> DataFrame:
    """Per destination: decisions, share of all, mean decision time, accuracy and error rate."""
    per = decisions.groupBy(destination).agg(
        F.count(F.lit(1)).alias("decisions"), F.avg(duration).alias("average_decision_time"),
        F.avg(correct.cast("double")).alias("routing_accuracy"), F.avg(error.cast("double")).alias("error_rate"))
    total = F.sum("decisions").over(W.partitionBy())  # over one row per destination
    return per.withColumn("utilization", F.col("decisions") / total)


def note_status(events: DataFrame, note_id: str = "note_id", event_type: str = "event_type",
                order_by: str = "timestamp") -> DataFrame:
    """Latest event of every note."""
    return events.groupBy(note_id).agg(F.max_by(event_type, order_by).alias("status"),
                                       F.max(order_by).alias("last_seen"))
