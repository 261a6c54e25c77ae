"""Registered streaming queries: each runs to the end of what is there and returns its sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.operators import routing as rt
from notemill.operators.validation import validate_content
from notemill.plans import inputs as inp
from notemill.plans.queries_files import ORACLE as FILE_ORACLE
from notemill.plans.queries_text import ORACLE as TEXT_ORACLE
from notemill.runtime import scratch_path
from notemill.sources import readers as rd
from notemill.sources import writers as wr
from notemill.streaming import streams as st

QUERIES = {}
ORACLE = {}
T = inp.SQL_TELEMETRY


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = inp.table(spark, sf, name).schema
    path = f"{sf}/{name}.parquet"
    # a table may be one file or a folder of part files; a stream reads folders
    return (rd.stream_parquet(spark, path, schema) if rd.is_folder(spark, path)
            else rd.stream_parquet(spark, sf, schema, f"{name}.parquet"))


def _telemetry(spark, sf):
    return _stream(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("component_"), (F.col("user_id") % 6).cast("string")).alias("component"),
        F.col("value").alias("duration_ms"), "user_id", "event_type", (F.col("event_type") == "error").alias("is_error"))


@_query("stream_routing", f"""WITH {inp.SQL_ROUTED}
SELECT note_id, routed_tag, round(sim, 4) AS similarity_score, round(conf, 4) AS confidence FROM routed""")
def stream_routing(spark, sf):
    index = rt.build_index(inp.centroid_tags(inp.labelled_vectors(spark, sf)))
    notes = _stream(spark, sf, "embeddings").select(F.col("vec_id").alias("note_id"), F.col("embedding").alias("vector"))
    out = st.run_available(st.route_stream(notes, index).drop("vector"))
    return out.select("note_id", "routed_tag", F.round("similarity_score", 4).alias("similarity_score"),
                      F.round("confidence", 4).alias("confidence"))


def _lines(spark, sf):
    """The capture lines of the batch queries, from a stream of documents."""
    docs = _stream(spark, sf, "documents")
    return inp.dress_as_lines(docs)


@_query("stream_parse", f"""WITH {inp.SQL_PARSED} SELECT note_id, array_to_string(tags, ',') AS tags, body, valid FROM checked""")
def stream_parse(spark, sf):
    parsed = st.parse_stream(_lines(spark, sf), inp.RUN_TS)
    return st.run_available(parsed.select("note_id", F.array_join("tags", ",").alias("tags"), "body", "valid"))


@_query("stream_fanout", TEXT_ORACLE["fanout_sink"])
def stream_fanout(spark, sf):
    path = scratch_path(spark, "stream_by_tag")
    parsed = st.parse_stream(_lines(spark, sf), inp.RUN_TS)
    st.start_fan_out(parsed, f"{path}/out", f"{path}/state", available_now=True).awaitTermination()
    rows = wr.read_by_tag(spark, f"{path}/out")
    return rows.select("tag", "body", "comment", "timestamp", "valid", F.array_join("issues", "|").alias("issues"),
                       F.array_join("all_tags", ",").alias("all_tags"))


@_query("stream_text_lines", FILE_ORACLE["capture_file"])
def stream_text_lines(spark, sf):
    """Capture lines that arrive as text files."""
    path = scratch_path(spark, "lines")
    wr.write_lines(inp.capture_lines(spark, sf).select("raw_text"), path)
    lines = st.run_available(rd.stream_text(spark, path))
    return lines.groupBy(F.md5("raw_text").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@_query("stream_json_notes", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def stream_json_notes(spark, sf):
    """Notes that arrive as JSON files."""
    path = scratch_path(spark, "json_notes")
    wr.write_report(inp.table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    notes = st.run_available(rd.stream_json(spark, path, "doc_id bigint, lang string, text string"))
    return notes.select("doc_id", "lang", F.md5("text").alias("digest"))


@_query("stream_dedup_all", f"""SELECT min(doc_id) AS doc_id, md5({inp.sql_normalize('text')}) AS digest FROM documents WHERE text IS NOT NULL GROUP BY 2""")
def stream_dedup_all(spark, sf):
    """First arrivals over two runs of the stream: what the first wrote is not written again."""
    from notemill.functions.text import normalize_text

    path = scratch_path(spark, "dedup_all")
    for _ in range(2):   # the second run finds all arrivals known to its checkpoint
        st.start_deduplicated(_stream(spark, sf, "documents"), f"{path}/out", f"{path}/state", order_by="doc_id",
                              available_now=True).awaitTermination()
    kept = st.read_deduplicated(spark, f"{path}/out", inp.table(spark, sf, "documents").schema)
    return kept.select("doc_id", F.md5(normalize_text(F.col("text"))).alias("digest"))


@_query("stream_dedup", f"""SELECT DISTINCT {inp.sql_normalize('text')} AS text FROM documents""")
def stream_dedup(spark, sf):
    from notemill.functions.text import normalize_text

    docs = _stream(spark, sf, "documents").withColumn(
        "ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=F.col("doc_id") % 3000))
    return st.run_available(st.deduplicate_stream(docs, "ts")).select(normalize_text(F.col("text")).alias("text"))


# A window is written once the watermark (latest time minus delay) has reached its end.
@_query("stream_metrics", f"""WITH {T},
w AS (SELECT time_bucket(INTERVAL 30 SECOND, timestamp) AS s, * FROM telemetry)
SELECT s AS window_start, s + INTERVAL 30 SECOND AS window_end, count(*) AS n, round(avg(duration_ms), 4) AS processing_time_ms,
  round(avg(is_error::INT), 4) AS error_rate FROM w
WHERE s + INTERVAL 30 SECOND <= (SELECT date_trunc('millisecond', max(timestamp)) FROM telemetry) - INTERVAL 1 MINUTE GROUP BY s""")
def stream_metrics(spark, sf):
    windows = st.metric_windows(_telemetry(spark, sf), "timestamp", "duration_ms", F.col("is_error"))
    return st.run_available(windows).withColumns({
        "processing_time_ms": F.round("processing_time_ms", 4), "error_rate": F.round("error_rate", 4)})


@_query("stream_alerts", f"""WITH {T},
w AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS s, round(avg(is_error::INT), 2) AS r FROM telemetry GROUP BY 1)
SELECT s AS window_start, 'errors' AS type, r AS value FROM w
WHERE r > 0.2 AND s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(timestamp)) FROM telemetry) - INTERVAL 1 MINUTE""")
def stream_alerts(spark, sf):
    windows = st.metric_windows(_telemetry(spark, sf), "timestamp", "duration_ms", F.col("is_error"), "1 hour")
    alerts = st.alert_windows(windows.withColumn("error_rate", F.round("error_rate", 2)), error_rate=0.2)
    return st.run_available(alerts.select("window_start", "type", "value"))


@_query("stream_error_rate", f"""WITH {T},
s AS (SELECT *, unnest(generate_series(0, 11)) AS k FROM errors),
w AS (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) - k * INTERVAL 5 MINUTE AS s FROM s)
SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 8) AS error_rate FROM w
WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(timestamp)) FROM errors) - INTERVAL 1 HOUR GROUP BY s""")
def stream_error_rate(spark, sf):
    windows = st.error_rate_windows(_telemetry(spark, sf).filter("is_error"), "timestamp")
    return st.run_available(windows).withColumn("error_rate", F.round("error_rate", 8))


@_query("stream_health", f"""WITH {T},
w AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS s, component, count(*) AS n FROM errors GROUP BY 1, 2)
SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, component, n AS recent_errors,
  CASE WHEN n < 5 THEN 'warning' ELSE 'critical' END AS status FROM w
WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(timestamp)) FROM errors) - INTERVAL 1 HOUR""")
def stream_health(spark, sf):
    return st.run_available(st.health_windows(_telemetry(spark, sf).filter("is_error"), "timestamp"))


# gaps and islands; a session is closed once the watermark (in whole milliseconds) is past its end
@_query("stream_sessions", f"""WITH {T},
e AS (SELECT user_id AS note_id, timestamp AS t, CASE WHEN operation = 'purchase' THEN 'note.processed' WHEN is_error THEN 'note.failed'
  ELSE 'note.created' END AS kind FROM telemetry WHERE timestamp IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY note_id ORDER BY t)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY note_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT note_id, min(t) AS session_start, max(t) + INTERVAL 10 MINUTE AS session_end, count(*) AS n, arg_max(kind, t) AS status,
  bool_and(kind = 'note.created') AS timed_out FROM i GROUP BY note_id, island)
SELECT * FROM s WHERE -(-epoch_us(session_end) // 1000) < (SELECT epoch_ms(max(t)) FROM e) - 600000""")
def stream_sessions(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "note.processed").when(
        F.col("is_error"), "note.failed").otherwise("note.created")
    events = _telemetry(spark, sf).select("timestamp", F.col("user_id").alias("note_id"), kind.alias("event_type"))
    return st.run_available(st.stalled_notes(events, "timestamp"))


@_query("stream_validate", """
SELECT page_id, length(html) BETWEEN 10 AND 10000 AND NOT regexp_matches(html, '(?i)<script>|javascript:|data:') AS content_valid FROM pages""")
def stream_validate(spark, sf):
    checked = validate_content(_stream(spark, sf, "pages"), "html", ("html",))
    return st.run_available(checked.select("page_id", "content_valid"))
