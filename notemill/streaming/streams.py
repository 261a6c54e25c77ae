"""Streaming routing, de-duplication, fan-out, windowed rates, health and alerts.

Every function takes a streaming DataFrame; the narrow operators (parsing,
validation, embedding, routing) are used on streams as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from notemill.functions import text as tx
from notemill.operators.notes import fan_out, keep_first, key_digest, parse_capture
from notemill.operators.observability import health_status
from notemill.operators.recommendations import monitor_alerts
from notemill.operators.routing import TagIndex, route
from notemill.runtime import cut_lineage, scratch_path


def route_stream(notes: DataFrame, index: TagIndex, vector: str = "vector", top_k: int = 3,
                 confidence_threshold: float | None = None) -> DataFrame:
    """Stateless routing. The index must be under the broadcast bound, as a larger one needs joins."""
    routed = route(notes, index, vector, top_k=top_k, confidence_threshold=confidence_threshold)
    if not routed.isStreaming:
        raise ValueError("route_stream needs a streaming input")
    return routed


def parse_stream(lines: DataFrame, run_ts: str | None = None) -> DataFrame:
    return parse_capture(lines, run_ts=run_ts)


def deduplicate_stream(notes: DataFrame, ts: str, text: str = "text", within: str = "1 hour") -> DataFrame:
    """First arrival of each normalised text; state is dropped once the watermark has passed."""
    keyed = notes.withColumn("_key", F.sha2(tx.normalize_text(F.col(text)), 256))
    return keyed.withWatermark(ts, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def metric_windows(events: DataFrame, ts: str, value: str, is_error: Column, width: str = "30 seconds",
                   delay: str = "1 minute") -> DataFrame:
    """Tumbling windows: events, mean value, error rate."""
    return (
        events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("processing_time_ms"),
             F.avg(is_error.cast("double")).alias("error_rate"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                "processing_time_ms", "error_rate")
    )


def error_rate_windows(errors: DataFrame, ts: str, width: str = "1 hour", slide: str = "5 minutes",
                       delay: str = "1 hour", seconds: int = 3600) -> DataFrame:
    """Sliding windows: errors and errors per second; later rows than the delay are dropped."""
    return (
        errors.withWatermark(ts, delay).groupBy(F.window(ts, width, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n",
                (F.col("n") / F.lit(float(seconds))).alias("error_rate"))
    )


def health_windows(errors: DataFrame, ts: str, component: str = "component", width: str = "1 hour",
                   delay: str = "1 hour") -> DataFrame:
    """Errors and health per component and hour."""
    return (
        errors.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), F.col(component).alias("component"))
        .agg(F.count(F.lit(1)).alias("recent_errors"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "component",
                "recent_errors", health_status(F.col("recent_errors")).alias("status"))
    )


def alert_windows(windows: DataFrame, cpu_percent: Column | None = None, error_rate: float = 0.1) -> DataFrame:
    """Alerts from the metric windows."""
    cpu = cpu_percent if cpu_percent is not None else F.lit(0.0)
    return monitor_alerts(windows.withColumn("cpu_percent", cpu), error_rate=error_rate)


_ISLANDS = "starts array<bigint>, ends array<bigint>, counts array<bigint>, statuses array<string>, done array<boolean>"


def merge_islands(islands: list[tuple], gap: int) -> list[tuple]:
    """Runs (start, end, n, status, ended) in order, joined where less than ``gap`` or just that lies between them."""
    out: list[tuple] = []
    for run in sorted(islands):
        if out and run[0] <= out[-1][1] + gap:
            last = out[-1]
            status = run[3] if run[1] >= last[1] else last[3]
            out[-1] = (last[0], max(last[1], run[1]), last[2] + run[2], status, last[4] or run[4])
        else:
            out.append(run)
    return out


def stalled_notes(events: DataFrame, ts: str, note_id: str = "note_id", gap: str = "10 minutes",
                  delay: str = "10 minutes") -> DataFrame:
    """One row per session of a note's events, as soon as the watermark is a gap past its last event.

    The state of a note is its open sessions only (start, end, number, status); an event-time
    timer on the first of them reports a note that went quiet while no further event of it arrives.
    ``timed_out`` says that it was neither processed nor failed. Events later than the watermark are dropped.
    """
    micros = events.sparkSession.range(1).select(F.expr(f"(unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {gap}))")).first()[0]
    id_type = events.schema[note_id].dataType.simpleString()
    schema = f"`{note_id}` {id_type}, start bigint, end bigint, n bigint, status string, timed_out boolean"

    def follow(key, frames, state):
        runs = list(zip(*state.get)) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["_at"].to_numpy()
                ended = frame["event_type"].isin(["note.processed", "note.failed"]).to_numpy()
                runs += [(int(t), int(t), 1, kind, bool(e)) for t, kind, e in zip(at, frame["event_type"], ended)]
        runs = merge_islands(runs, micros)
        watermark = state.getCurrentWatermarkMs()
        timer = lambda run: -(-(run[1] + micros) // 1000)
        closed = [r for r in runs if timer(r) < watermark]
        open_ = [r for r in runs if timer(r) >= watermark]
        if open_:
            state.update(tuple(list(c) for c in zip(*open_)))
            state.setTimeoutTimestamp(max(min(map(timer, open_)), watermark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({note_id: [key[0]] * len(closed), "start": [r[0] for r in closed], "end": [r[1] for r in closed],
                            "n": [r[2] for r in closed], "status": [r[3] for r in closed], "timed_out": [not r[4] for r in closed]})

    slim = events.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        note_id, ts, F.unix_micros(ts).alias("_at"), F.coalesce("event_type", F.lit("")).alias("event_type"))
    found = slim.groupBy(note_id).applyInPandasWithState(
        follow, schema, _ISLANDS, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(note_id, F.timestamp_micros("start").alias("session_start"),
                        F.timestamp_micros(F.col("end") + micros).alias("session_end"), "n", "status", "timed_out")


# --- sinks -----------------------------------------------------------------

def start_fan_out(parsed: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                  files_per_tag: int = 4) -> StreamingQuery:
    """Write every note to the folders of its tags as it arrives, as ``tag_dir=<tag>/batch=<number>``.

    A tag gets at most ``files_per_tag`` files a batch, however many tasks the batch had; as many
    tasks share a tag that holds most of the notes. A batch that is run again replaces its own files.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = fan_out(batch).withColumn("tag_dir", F.col("tag")).withColumn("batch", F.lit(number))
        salt = F.pmod(F.xxhash64("body", "comment", "timestamp"), F.lit(files_per_tag))
        tasks = batch.sparkSession.conf.get("spark.sql.shuffle.partitions")
        (rows.repartition(int(tasks), "tag_dir", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("tag_dir", "batch").json(path))

    writer = parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_deduplicated(notes: DataFrame, path: str, checkpoint: str, text: str = "text", order_by: str | None = None,
                       available_now: bool = False) -> StreamingQuery:
    """Append the first arrival of each normalised text, over all arrivals ever.

    The digests of what was written are a table of their own (32 bytes a text) that each batch is
    anti-joined with, so that the memory of a run does not grow with its history. ``order_by``
    says which of several arrivals in one batch is first. Both tables are written by batch number, so
    that a batch that is run again replaces its own rows. Read ``path/notes`` with ``read_deduplicated``.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("_text_key", tx.normalize_text(F.col(text))).filter(F.col("_text_key").isNotNull())
        first = keep_first(keyed, ["_text_key"], order_by) if order_by else keyed.dropDuplicates(["_text_key"])
        first = first.withColumn("_digest", key_digest(["_text_key"])).drop("_text_key")
        if number > 0:
            seen = spark.read.schema("_digest binary, _batch bigint").parquet(f"{path}/seen").filter(F.col("_batch") < number)
            first = first.join(seen, "_digest", "left_anti")
        fresh = cut_lineage(first)
        for name, rows in (("notes", fresh.drop("_digest")), ("seen", fresh.select("_digest"))):
            (rows.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(f"{path}/{name}"))

    writer = notes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_deduplicated(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``start_deduplicated`` has written for an input of ``schema``."""
    return spark.read.schema(schema).parquet(f"{path}/notes").select(*schema.names)


def start_append(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 partition_by: list[str] | None = None, available_now: bool = False) -> StreamingQuery:
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_available(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Process what is there now into a written table in the shared folder, and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, "stream")
    query = start_append(df, f"{path}/out", f"{path}/state", "parquet", partition_by, available_now=True)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
