"""Registered queries over operational events."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.operators import observability as ob
from notemill.operators import recommendations as rec
from notemill.plans import flows as fl
from notemill.plans import inputs as inp
from notemill.runtime import scratch_path
from notemill.sources import writers as wr

QUERIES = {}
ORACLE = {}
T = inp.SQL_TELEMETRY
NOW = f"TIMESTAMP '{inp.RUN_NOW}'"


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def _now():
    return F.lit(inp.RUN_NOW).cast("timestamp")


def _round(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _log(spark, sf):
    """Event log with metric maps: errors as error events, the rest as timings."""
    rows = inp.telemetry(spark, sf)
    timings = ob.performance_events(rows.filter(~F.col("is_error")).withColumn(
        "memory_usage_mb", (F.col("user_id") % 3).cast("double")))
    errors = ob.error_events(rows.filter("is_error").select(
        "timestamp", "component", F.concat(F.lit("failed for user "), F.col("user_id").cast("string")).alias("message"),
        F.when(F.col("user_id") % 5 != 0, F.col("error_type")).alias("error_type"),
        F.lit(None).cast("string").alias("stack_trace"), F.lit(None).cast("map<string,string>").alias("context")))
    return timings.unionByName(errors)


@_query("event_log", f"""WITH {T}
SELECT event_type, component, message, count(*) AS n FROM (
  SELECT 'error' AS event_type, component, 'failed for user ' || user_id AS message FROM errors
  UNION ALL SELECT 'performance', component, printf('%s completed in %.2fms', operation, duration_ms) FROM telemetry WHERE NOT is_error) GROUP BY ALL""")
def event_log(spark, sf):
    return _log(spark, sf).groupBy("event_type", "component", "message").agg(F.count(F.lit(1)).alias("n"))


@_query("prediction_log", f"""WITH {inp.SQL_ROUTED}
SELECT 'Predicted tag ''' || routed_tag || ''' for note ' || note_id AS message, 'router' AS component, 'prediction' AS event_type,
  round(conf, 4) AS confidence, round(sim, 4) AS similarity, 'centroid' AS model FROM routed""")
def prediction_log(spark, sf):
    from notemill.operators import routing as rt

    notes = inp.labelled_vectors(spark, sf)
    routed = rt.route(notes, rt.build_index(inp.centroid_tags(notes))).withColumn(
        "timestamp", _now()).withColumn("processing_time_ms", F.lit(1.0))
    log = ob.prediction_events(routed, model="centroid")
    return log.select("message", "component", "event_type",
                      F.round(F.col("performance_metrics")["confidence"], 4).alias("confidence"),
                      F.round(F.col("performance_metrics")["similarity_score"], 4).alias("similarity"),
                      F.col("metadata")["model_name"].alias("model"))


@_query("training_log", """
SELECT 'training' AS event_type, 'evaluator' AS component, printf('Trained model %s on %d samples', source, count(*)) AS message,
  count(*)::VARCHAR AS num_samples, round(sum(n_chars) / 1000.0::DOUBLE, 6) AS training_time_seconds, round(avg(n_chars), 6) AS mean_chars
FROM documents WHERE source IS NOT NULL GROUP BY source""")
def training_log(spark, sf):
    """A training event for each source, as if a model were fitted to its documents."""
    runs = inp.table(spark, sf, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("model_name")).agg(
        F.count(F.lit(1)).alias("num_samples"), (F.sum("n_chars") / 1000.0).alias("training_time_seconds"),
        F.create_map(F.lit("mean_chars"), F.avg("n_chars")).alias("metrics")).withColumn("timestamp", _now())
    m = F.col("performance_metrics")
    return ob.training_events(runs).select(
        "event_type", "component", "message", F.col("metadata")["num_samples"].alias("num_samples"),
        F.round(m["training_time_seconds"], 6).alias("training_time_seconds"), F.round(m["mean_chars"], 6).alias("mean_chars"))


@_query("metric_summary", f"""WITH {T},
m AS (SELECT 'duration_ms' AS metric, duration_ms AS v FROM telemetry WHERE NOT is_error
  UNION ALL SELECT 'memory_usage_mb', (user_id % 3)::DOUBLE FROM telemetry WHERE NOT is_error AND user_id % 3 <> 0)
SELECT metric, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, count(*) AS count FROM m GROUP BY 1""")
def metric_summary(spark, sf):
    return _round(ob.metric_summary(_log(spark, sf)), "mean")


@_query("error_counts", f"""WITH {T}
SELECT CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE error_type END AS error_type, count(*) AS count FROM errors GROUP BY 1""")
def error_counts(spark, sf):
    return ob.error_counts(_log(spark, sf).filter("event_type = 'error'").select("error_details.error_type"))


@_query("events_between", f"""WITH {T}
SELECT event_id FROM telemetry WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""")
def events_between(spark, sf):
    from datetime import datetime

    return ob.events_between(inp.telemetry(spark, sf), datetime(2024, 1, 10), datetime(2024, 1, 12)).select("event_id")


@_query("recent_metrics", """
WITH s AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100),
m AS (SELECT 'cpu_percent' AS metric, (user_id % 100)::DOUBLE AS v FROM s UNION ALL SELECT 'memory_mb', user_id * 10.0::DOUBLE FROM s
  UNION ALL SELECT 'processing_time_ms', value FROM s UNION ALL SELECT 'throughput_notes_per_second', (event_id % 50)::DOUBLE FROM s
  UNION ALL SELECT 'error_rate', (event_type = 'error')::INT::DOUBLE FROM s)
SELECT metric, round(avg(v), 4) AS mean, max(v) AS max, min(v) AS min FROM m GROUP BY 1""")
def recent_metrics(spark, sf):
    return _round(ob.recent_metrics_summary(inp.metric_samples(spark, sf), ["timestamp", "event_id"]), "mean")


@_query("processing_totals", f"""WITH {T}
SELECT count(*) FILTER (NOT is_error) AS total_notes_processed, count(*) FILTER (is_error) AS total_errors FROM telemetry""")
def processing_totals(spark, sf):
    return ob.processing_totals(inp.telemetry(spark, sf), F.col("is_error"))


@_query("collect_metrics", f"""WITH {T},
r AS (SELECT duration_ms FROM telemetry WHERE NOT is_error ORDER BY timestamp DESC, event_id DESC LIMIT 100)
SELECT round(count(*) FILTER (NOT is_error) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6), 6) AS throughput_notes_per_second,
  round(count(*) FILTER (is_error) / count(*) FILTER (NOT is_error)::DOUBLE, 6) AS error_rate,
  (SELECT round(avg(duration_ms), 6) FROM r) AS processing_time_ms FROM telemetry""")
def collect_metrics(spark, sf):
    out = ob.collect_metrics(inp.telemetry(spark, sf), "duration_ms", "timestamp", ["timestamp", "event_id"],
                             F.col("is_error"))
    return _round(out, "throughput_notes_per_second", "error_rate", "processing_time_ms", digits=6)


@_query("error_summary", f"""WITH {T}
SELECT 'total' AS level, 'all' AS key, count(*) AS count FROM errors
UNION ALL SELECT 'type', error_type, count(*) FROM errors GROUP BY error_type
UNION ALL SELECT 'component', component, count(*) FROM errors GROUP BY component""")
def error_summary(spark, sf):
    return ob.error_summary(inp.error_rows(spark, sf))


@_query("error_matrix", f"""WITH {T},
e AS (SELECT *, timestamp > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR AS recent FROM errors)
SELECT coalesce(component, 'all') AS component, coalesce(error_type, 'all') AS error_type, count(*) AS count, count(*) FILTER (recent) AS recent
FROM e GROUP BY GROUPING SETS ((component, error_type), (error_type), ())""")
def error_matrix(spark, sf):
    return ob.error_matrix(inp.error_rows(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@_query("latest_errors", f"""WITH {T} SELECT event_id, component FROM errors ORDER BY timestamp DESC, event_id DESC LIMIT 10""")
def latest_errors(spark, sf):
    return ob.latest(inp.error_rows(spark, sf), ["timestamp", "event_id"]).select("event_id", "component")


@_query("common_errors", f"""WITH {T} SELECT error_type, count(*) AS count FROM errors GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def common_errors(spark, sf):
    return ob.most_common_errors(inp.error_rows(spark, sf), 3)


@_query("error_rate", f"""WITH {T}
SELECT round(count(*) FILTER (timestamp BETWEEN TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR AND TIMESTAMP '2024-01-30 12:00:00') / 3600.0::DOUBLE, 8) AS error_rate FROM errors""")
def error_rate(spark, sf):
    return _round(ob.error_rate(inp.error_rows(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp")),
                  "error_rate", digits=8)


@_query("component_health", f"""WITH {T},
c AS (SELECT component, count(*) AS total_errors, count(*) FILTER (timestamp BETWEEN TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 3 HOUR AND TIMESTAMP '2024-01-30 12:00:00') AS recent_errors
  FROM errors GROUP BY 1)
SELECT *, CASE WHEN recent_errors = 0 THEN 'healthy' WHEN recent_errors < 5 THEN 'warning' ELSE 'critical' END AS status FROM c""")
def component_health(spark, sf):
    return ob.component_health(inp.error_rows(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp"), 3 * 3600)


@_query("trailing_avg", f"""WITH {T}
SELECT event_id, component, round(avg(duration_ms) OVER (PARTITION BY component ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 8) AS trailing_avg FROM telemetry""")
def trailing_avg(spark, sf):
    rows = inp.telemetry(spark, sf).select("component", "timestamp", "event_id", "duration_ms")
    out = ob.trailing_average(rows, "component", ["timestamp", "event_id"], "duration_ms")
    return out.select("event_id", "component", F.round("trailing_avg", 8).alias("trailing_avg"))


@_query("trailing_error_rate", f"""WITH {T}
SELECT event_id, component, count(*) OVER w AS errors_in_window, round(count(*) OVER w / 3600.0::DOUBLE, 8) AS error_rate FROM errors
WINDOW w AS (PARTITION BY component ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def trailing_error_rate(spark, sf):
    rows = inp.error_rows(spark, sf).select("component", "timestamp", "event_id")
    out = ob.trailing_error_rate(rows, "component", "timestamp")
    return out.select("event_id", "component", "errors_in_window", F.round("error_rate", 8).alias("error_rate"))


@_query("latency_percentiles", f"""WITH {T},
l AS (SELECT operation, list_sort(list(duration_ms)) AS s, avg(duration_ms) AS m FROM telemetry GROUP BY 1)
SELECT operation, len(s) AS total_processed, s[len(s) // 2 + 1] AS median_time, s[floor(len(s) * 0.95::DOUBLE)::BIGINT + 1] AS p95_time,
  s[floor(len(s) * 0.99::DOUBLE)::BIGINT + 1] AS p99_time, round(m, 4) AS average_time, s[1] AS min_time, s[len(s)] AS max_time FROM l""")
def latency_percentiles(spark, sf):
    return _round(ob.latency_summary(inp.telemetry(spark, sf), "operation", "duration_ms"), "average_time")


@_query("latency_sketch", f"""WITH {T}
SELECT operation, count(duration_ms) AS total_processed, round(avg(duration_ms), 4) AS average_time, min(duration_ms) AS min_time,
  max(duration_ms) AS max_time, true AS median_near, true AS p95_near, true AS p99_near FROM telemetry GROUP BY 1""")
def latency_sketch(spark, sf):
    """The sketch's quantiles, held against the ranks that they have among all values: each within a thousandth of the rows, or one row."""
    rows = inp.telemetry(spark, sf).select("operation", "duration_ms")
    sketch = ob.latency_summary_approx(rows, "operation", "duration_ms")
    q = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    n, value = F.col("total_processed"), F.col("duration_ms")
    near = []
    for name, share in q.items():
        below, upto = F.sum((value < F.col(f"{name}_time")).cast("long")), F.sum((value <= F.col(f"{name}_time")).cast("long"))
        slack = F.greatest(F.lit(1.0), F.first("total_processed") * 0.001)
        near.append(((below - slack <= F.first("total_processed") * share) & (upto + slack >= F.first("total_processed") * share)).alias(f"{name}_near"))
    ranks = rows.join(F.broadcast(sketch), "operation").groupBy("operation").agg(*near)   # a row an operation
    return _round(sketch.select("operation", n, "average_time", "min_time", "max_time"), "average_time").join(ranks, "operation")


@_query("operation_summary", f"""WITH {T}
SELECT component, round(avg(duration_ms), 4) AS average_time, round(avg((NOT is_error)::INT), 4) AS success_rate, count(*) AS total_operations FROM telemetry GROUP BY 1""")
def operation_summary(spark, sf):
    return _round(ob.operation_summary(inp.telemetry(spark, sf), "component", "duration_ms", ~F.col("is_error")),
                  "average_time", "success_rate")


@_query("batch_summary", f"""WITH {T}
SELECT event_id // 500 AS batch_id, count(*) AS total, count(*) FILTER (NOT is_error) AS successful, count(*) FILTER (is_error) AS failed,
  round(sum(duration_ms), 2) AS processing_time FROM telemetry GROUP BY 1""")
def batch_summary(spark, sf):
    rows = inp.telemetry(spark, sf).withColumn("batch_id", F.floor(F.col("event_id") / 500))
    return _round(ob.batch_summary(rows, "batch_id", ~F.col("is_error"), "duration_ms"), "processing_time", digits=2)


@_query("note_status", """
SELECT user_id AS note_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_seen FROM events GROUP BY 1""")
def note_status(spark, sf):
    rows = inp.telemetry(spark, sf).select(F.col("user_id").alias("note_id"), F.col("operation").alias("event_type"),
                                           F.struct("timestamp", "event_id").alias("at"))
    out = ob.note_status(rows, order_by="at")
    return out.select("note_id", "status", F.col("last_seen.timestamp").alias("last_seen"))


@_query("monitor_alerts", f"""WITH {T},
m AS (SELECT component, max(user_id % 100)::DOUBLE AS cpu_percent, round(avg(is_error::INT), 2) AS error_rate FROM telemetry GROUP BY 1)
SELECT component, 'cpu' AS type, cpu_percent AS value, 90.0::DOUBLE AS bound FROM m WHERE cpu_percent > 90
UNION ALL SELECT component, 'errors', error_rate, 0.1 FROM m WHERE error_rate > 0.1""")
def monitor_alerts(spark, sf):
    metrics = inp.telemetry(spark, sf).groupBy("component").agg(
        F.max(F.col("user_id") % 100).cast("double").alias("cpu_percent"),
        F.round(F.avg(F.col("is_error").cast("double")), 2).alias("error_rate"))
    return rec.monitor_alerts(metrics).select("component", "type", "value", "bound")


@_query("performance_alerts", f"""WITH {T},
m AS (SELECT component, avg(duration_ms) AS t, max(user_id % 100)::DOUBLE AS c, avg(is_error::INT) AS e FROM telemetry GROUP BY 1)
SELECT component, 'time' AS type, round(t, 6) AS value, 5.0::DOUBLE AS bound, 'warning' AS severity FROM m WHERE t > 5
UNION ALL SELECT component, 'cpu', c, 80, 'warning' FROM m WHERE c > 80
UNION ALL SELECT component, 'errors', round(e, 6), 0.05, 'critical' FROM m WHERE e > 0.05""")
def performance_alerts(spark, sf):
    metrics = inp.telemetry(spark, sf).groupBy("component").agg(
        F.avg("duration_ms").alias("average_time"), F.max(F.col("user_id") % 100).cast("double").alias("cpu_average"),
        F.avg(F.col("is_error").cast("double")).alias("error_rate"))
    return rec.performance_alerts(metrics).select("component", "type", F.round("value", 6).alias("value"), "bound", "severity")


# --- exports ----------------------------------------------------------------

@_query("exported_metrics", f"""WITH {T},
s AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100),
m AS (SELECT 'cpu_percent' AS metric, (user_id % 100)::DOUBLE AS v FROM s UNION ALL SELECT 'memory_mb', user_id * 10.0::DOUBLE FROM s
  UNION ALL SELECT 'processing_time_ms', value FROM s UNION ALL SELECT 'throughput_notes_per_second', (event_id % 50)::DOUBLE FROM s
  UNION ALL SELECT 'error_rate', (event_type = 'error')::INT::DOUBLE FROM s)
SELECT 'summary' AS section, metric AS key, round(avg(v), 4) AS value FROM m GROUP BY 2
UNION ALL SELECT 'history', event_id::VARCHAR, round(value, 4) FROM events""")
def exported_metrics(spark, sf):
    """Written as sections and read back."""
    path = scratch_path(spark, "metrics")
    fl.export_metrics(inp.metric_samples(spark, sf), path, ["timestamp", "event_id"])
    summary, history = (wr.read_section(spark, path, name) for name in ("summary", "history"))
    return summary.select(F.lit("summary").alias("section"), F.col("metric").alias("key"), F.round("mean", 4).alias("value")).unionByName(
        history.select(F.lit("history").alias("section"), F.col("event_id").cast("string").alias("key"),
                       F.round("processing_time_ms", 4).alias("value")))


@_query("exported_errors", f"""WITH {T},
rate AS (SELECT count(*) FILTER (timestamp > {NOW} - INTERVAL 1 HOUR) AS n FROM errors),
newest AS (SELECT event_id FROM errors ORDER BY timestamp DESC, event_id DESC LIMIT 10)
SELECT 'summary' AS section, 'total:all' AS key, count(*) AS n FROM errors
UNION ALL SELECT 'summary', 'type:' || error_type, count(*) FROM errors GROUP BY error_type
UNION ALL SELECT 'summary', 'component:' || component, count(*) FROM errors GROUP BY component
UNION ALL SELECT 'component_health', component, count(*) FILTER (timestamp > {NOW} - INTERVAL 1 HOUR) FROM errors GROUP BY component
UNION ALL SELECT 'most_common_errors', error_type, count(*) FROM errors GROUP BY error_type
UNION ALL SELECT 'recent_errors', event_id::VARCHAR, 1 FROM newest
UNION ALL SELECT 'all_errors', event_id::VARCHAR, 1 FROM errors""")
def exported_errors(spark, sf):
    """All sections of the error export, read back."""
    path = scratch_path(spark, "errors")
    fl.export_errors(inp.error_rows(spark, sf), _now(), path, ["timestamp", "event_id"])
    section = lambda name: wr.read_section(spark, path, name)
    out = None
    for name, key, n in (("summary", F.concat_ws(":", "level", "key"), F.col("count")),
                         ("component_health", F.col("component"), F.col("recent_errors")),
                         ("most_common_errors", F.col("error_type"), F.col("count")),
                         ("recent_errors", F.col("event_id").cast("string"), F.lit(1)),
                         ("all_errors", F.col("event_id").cast("string"), F.lit(1))):
        rows = section(name).select(F.lit(name).alias("section"), key.alias("key"), n.cast("bigint").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out
