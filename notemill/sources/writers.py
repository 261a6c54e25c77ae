"""Sinks: per-tag fan-out, reports, calibrators, CSV and Markdown exports."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from notemill.operators.calibration import Calibrator
from notemill.operators.notes import fan_out

PARSED_SCHEMA = (
    "tags array<string>, body string, comment string, timestamp string, raw_text string, valid boolean, "
    "issues array<string>, metadata map<string,string>"
)
CALIBRATOR_SCHEMA = (
    "method string, is_fitted boolean, parameters struct<intercept:double,coefficient:double>"
)

CSV_FILE_BYTES = 128 << 20   # of a large CSV file, about


def write_large_csv(df: DataFrame, path: str, file_bytes: int | None = None) -> None:
    """Quoted CSV with a header line in every file: one file, or as many as keep each at about ``file_bytes``.

    Every file is written by one task, so that its bytes bound what a task reads.
    """
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    n = -(-(df.agg(F.sum(size)).first()[0] or 0) // (file_bytes or CSV_FILE_BYTES))
    parts = df.repartition(n, F.xxhash64(*df.columns)) if n > 1 else df.coalesce(1)
    parts.write.csv(path, header=True, escape='"')


def write_by_tag(parsed: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> None:
    """Append one JSON row per (note, tag) under ``tag_dir=<tag>``; the row keeps its tag.

    Rows are rebalanced by tag so that a tag gets few files; adaptive execution
    splits a tag that is too big for one task.
    """
    rows = fan_out(parsed).withColumn("tag_dir", F.col("tag")).hint("rebalance", F.col("tag_dir"))
    rows.write.mode("append").option("maxRecordsPerFile", max_records_per_file).partitionBy("tag_dir").json(path)


def read_by_tag(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    schema = ("tag string, body string, comment string, timestamp string, valid boolean, issues array<string>, "
              "metadata map<string,string>, all_tags array<string>, tag_dir string")
    rows = spark.read.schema(schema).json(path)
    return rows.filter(F.col("tag_dir") == tag) if tag else rows


def to_record(df: DataFrame, columns: list[str] | None = None, out: str = "record") -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias(out))


def from_record(records: DataFrame, column: str = "record") -> DataFrame:
    """JSON text to parsed notes, with defaults for absent fields."""
    empty_list, text = F.array().cast("array<string>"), F.lit("")
    row = F.from_json(column, PARSED_SCHEMA)
    get = lambda name, default: F.coalesce(row[name], default).alias(name)
    return records.select(
        get("tags", empty_list), get("body", text), row["comment"].alias("comment"), get("timestamp", text),
        get("raw_text", text), get("valid", F.lit(False)), get("issues", empty_list),
        get("metadata", F.create_map().cast("map<string,string>")))


def pack(df: DataFrame) -> Column:
    """A small result table as one array-of-struct value, for report rows."""
    return df.agg(F.collect_list(F.struct(*df.columns))).scalar()


def pack_row(df: DataFrame) -> Column:
    """A one-row result as one struct value."""
    return df.select(F.struct(*df.columns)).scalar()


def messages(recommendations: DataFrame) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("position", "recommendation")))
    return recommendations.agg(F.transform(ordered, lambda m: m["recommendation"])).scalar()


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.write.mode("overwrite").json(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Several result tables as one JSON dataset each below a folder.

    The list of sections is written last, so that a folder without it is an export that did not end.
    """
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    spark = next(iter(sections.values())).sparkSession
    listed = [(name, df.schema.json()) for name, df in sections.items()]
    spark.createDataFrame(listed, "section string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/sections")


def read_section(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A section of a complete export, with the types it was written with."""
    listed = {r["section"]: r["schema"] for r in spark.read.schema("section string, schema string").json(f"{path}/sections").collect()}
    return spark.read.schema(StructType.fromJson(json.loads(listed[name]))).json(f"{path}/{name}")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """One JSON array of objects a partition, each in a file of its own."""
    def bracket(batches):
        before = "["
        for batch in batches:
            for item in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([before + item.as_py()])], ["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(bracket, "value string").write.mode("overwrite").text(path)


def write_csv(notes: DataFrame, path: str) -> None:
    notes.write.mode("overwrite").csv(path, header=True, escape='"')


def save_calibrator(spark: SparkSession, calibrator: Calibrator, path: str) -> None:
    if not calibrator.is_fitted:
        raise RuntimeError("the calibrator must be fitted before saving")
    calibrator.to_df(spark).write.mode("overwrite").json(path)


def load_calibrator(spark: SparkSession, path: str) -> Calibrator:
    row = spark.read.schema(CALIBRATOR_SCHEMA).json(path).first()
    if not row["is_fitted"]:
        return Calibrator(method=row["method"])
    return Calibrator(row["parameters"]["coefficient"], row["parameters"]["intercept"], row["method"])


def markdown_notes(routed: DataFrame, tags: str | None = None) -> DataFrame:
    """One Markdown text with front matter per routed note, with its tag for partitioning."""
    front = [
        F.lit("---"),
        F.concat(F.lit("note_id: "), F.col("note_id").cast("string")),
        F.concat(F.lit("tag: "), F.col("routed_tag")),
        F.format_string("confidence: %.4f", "confidence"),
        F.format_string("similarity: %.4f", "similarity_score"),
    ]
    if tags:
        front.append(F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")))
    return routed.select("routed_tag", F.concat_ws("\n", *front, F.lit("---"), F.lit(""), F.col("text")).alias("value"))


def write_markdown(routed: DataFrame, path: str, tags: str | None = None) -> None:
    markdown_notes(routed, tags).write.mode("overwrite").partitionBy("routed_tag").text(path)


def verify_hashes(stored: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Entries whose stored content hash differs from that of the current content."""
    now = current.select(key, F.sha2("content", 256).alias("current_hash"))
    return stored.join(now, key).filter(F.col("content_hash") != F.col("current_hash"))
