"""Note readers: CSV, delimited text, Markdown, JSON, folders, capture lines, streams."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.sources.records import JsonArray, QuotedLines, numbered_lines, read_records

NOTE_SCHEMA = "note_id string, text string, timestamp string, source_file string, original_text string"
LABELLED_SCHEMA = "note_id string, text string, timestamp string, true_tag string"


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NOTE_SCHEMA)


def _run_time(run_ts: str | None) -> Column:
    return F.lit(run_ts) if run_ts else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def _as_notes(df: DataFrame, text: Column, note_id: Column | None, timestamp: Column) -> DataFrame:
    """Strip, drop blanks, normalise. Without an id column the id is a digest of the file, the
    number of the record in it and the text, so that a re-run gives the same ids however the file is cut."""
    stripped = df.withColumn("_text", tx.strip_ws(text)).filter(F.col("_text") != "")
    place = F.concat_ws(":", "file", F.col("number").cast("string"), F.col("_text"))
    return stripped.select(
        (note_id if note_id is not None else F.sha2(place, 256)).cast("string").alias("note_id"),
        tx.normalize_text(F.col("_text")).alias("text"),
        timestamp.alias("timestamp"),
        F.col("file").alias("source_file"),
        F.col("_text").alias("original_text"),
    )


def read_csv_records(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, number, row): quoted CSV with a header line in every file; ``row`` has a string field a column.

    A large file is read by several tasks, also where values hold line feeds. None where nothing is readable.
    """
    try:
        records = read_records(spark, path, QuotedLines)
    except AnalysisException:
        return None
    head = records.filter("number = 0").orderBy("file").first()
    if head is None:
        return None
    names = next(csv.reader([head["record"].removeprefix("\ufeff")]), [])
    if not names or len({n.lower() for n in names}) < len(names):
        return None
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    row = F.from_csv("record", schema, {"escape": '"', "multiLine": "true"})
    return records.filter("number > 0 AND record <> ''").select("file", "number", row.alias("row"))


def read_csv_notes(spark: SparkSession, path: str, text_column: str = "text", id_column: str | None = None,
                   timestamp_column: str | None = None, run_ts: str | None = None) -> DataFrame:
    """Notes of a CSV file with header; no text column or no readable file gives no rows."""
    raw = read_csv_records(spark, path)
    columns = raw.schema["row"].dataType.names if raw is not None else []
    if text_column not in columns:
        return _empty(spark)
    known = lambda c: F.col("row")[c] if c and c in columns else None
    stamp = known(timestamp_column)
    return _as_notes(raw, F.col("row")[text_column], known(id_column), stamp if stamp is not None else _run_time(run_ts))


def _read_text(spark: SparkSession, path: str, separator: str) -> DataFrame | None:
    try:
        return numbered_lines(spark, path, separator)
    except AnalysisException:
        return None


def read_text_notes(spark: SparkSession, path: str, delimiter: str = "\n", run_ts: str | None = None) -> DataFrame:
    raw = _read_text(spark, path, delimiter)
    return _empty(spark) if raw is None else _as_notes(raw, F.col("value"), None, _run_time(run_ts))


def read_markdown_notes(spark: SparkSession, path: str, run_ts: str | None = None) -> DataFrame:
    """One note per paragraph; paragraphs that start with ``#`` are left out."""
    raw = _read_text(spark, path, "\n\n")
    if raw is None:
        return _empty(spark)
    body = raw.filter(~F.startswith(tx.strip_ws(F.col("value")), F.lit("#")))
    return _as_notes(body, F.col("value"), None, _run_time(run_ts))


def read_json_notes(spark: SparkSession, path: str, text_key: str = "text", run_ts: str | None = None,
                    lines: bool = False) -> DataFrame:
    """Notes of a JSON array of objects, or with ``lines`` of one object a line; large files are read by several tasks."""
    try:
        raw = (numbered_lines(spark, path).withColumnRenamed("value", "record") if lines
               else read_records(spark, path, JsonArray))
    except AnalysisException:
        return _empty(spark)
    key = text_key.replace("`", "``")
    return _as_notes(raw.withColumn("row", F.from_json("record", f"`{key}` string")), F.col("row")[text_key], None, _run_time(run_ts))


def read_note_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One note per file below a folder: title from the file name, category from its folder."""
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .text(path, wholetext=True).withColumn("file_path", F.col("_metadata.file_path"))
    )
    return raw.select(
        F.sha2("file_path", 256).alias("note_id"),
        F.col("value").alias("content"),
        F.regexp_extract("file_path", r"([^/]+)\.[^./]*$", 1).alias("title"),
        F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("category"),
        F.col("file_path").alias("source_file"),
    )


def read_capture_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw grammar lines, one note each, blank lines dropped."""
    lines = spark.read.text(path).select(tx.strip_ws(F.col("value")).alias("raw_text"))
    return lines.filter(F.col("raw_text") != "")


def read_labelled_notes(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV, every column a string; columns are matched by header name."""
    wanted = [c.split()[0] for c in LABELLED_SCHEMA.split(", ")]
    raw = read_csv_records(spark, path)
    if raw is None:
        return spark.createDataFrame([], LABELLED_SCHEMA)
    return raw.select(*[F.col("row")[c].alias(c) for c in wanted if c in raw.schema["row"].dataType.names])


def stream_text(spark: SparkSession, path: str) -> DataFrame:
    """Unbounded source of raw lines: files that arrive in a folder."""
    return spark.readStream.text(path).select(tx.strip_ws(F.col("value")).alias("raw_text")).filter(
        F.col("raw_text") != "")


def stream_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder, asked of the store that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def stream_parquet(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def get_note(notes: DataFrame, note_id, id_col: str = "note_id") -> DataFrame:
    """The stored note with this id, or no row; the filter reaches the file statistics."""
    return notes.filter(F.col(id_col) == F.lit(note_id))


def notes_by_category(notes: DataFrame, category: str, created: str = "created_at") -> DataFrame:
    return notes.filter(F.col("category") == category).orderBy(F.desc(created))


def first_notes(notes: DataFrame, order_by: str, n: int) -> DataFrame:
    """The first n notes, as a report or a trial run asks for them."""
    return notes.orderBy(order_by).limit(n)
