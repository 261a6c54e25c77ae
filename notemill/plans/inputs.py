"""How the given tables become the inputs of the operators, in Spark and, for checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_TS = "2025-01-31T00:00:00"
RUN_NOW = "2024-01-31 00:00:00"
VECTOR_THRESHOLD = 0.3
HASH_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL twins of the text helpers (RE2 escapes) ----------------------------

SQL_WS = (r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_WS}+', ' ', 'g'), ' ')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_normalize(x: str) -> str:
    return f"trim(translate(lower({sql_squeeze(x)}), '!\"''', '.'), ' ')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({sql_squeeze(x)}, ' '), lambda w: w <> '')"


# --- capture lines ----------------------------------------------------------

def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dress_as_lines(table(spark, sf_dir, "documents"))


def dress_as_lines(documents: DataFrame) -> DataFrame:
    """Whole documents as capture lines: some tagged, commented, stamped, some wrongly; and further lines without a body."""
    tags = F.when(F.col("doc_id") % 5 == 4, F.lit("")).otherwise(
        F.concat(F.lit("#"), "lang", F.lit(" #"), "source", F.lit(" #"), "lang", F.lit(" ")))
    tail = (
        F.when(F.col("doc_id") % 7 == 3, F.lit(" @2025-13-45T99:00:00"))
        .when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" //see "), "source", F.lit(" @2025-01-27T10:30:00")))
        .when(F.col("doc_id") % 3 == 1, F.lit(" @2025-01-27T10:30:00.25"))
        .otherwise(F.lit(""))
    )
    lines = documents.select(F.col("doc_id").alias("note_id"), F.concat(tags, "text", tail).alias("raw_text"))
    bare = documents.filter(F.col("doc_id") % 13 == 5).select(
        (-1 - F.col("doc_id")).alias("note_id"), F.concat(tags, tail).alias("raw_text"))
    return lines.unionByName(bare)


SQL_LINES = """
dressed AS (
  SELECT doc_id, text, CASE WHEN doc_id % 5 = 4 THEN '' ELSE '#' || lang || ' #' || source || ' #' || lang || ' ' END AS head,
    CASE WHEN doc_id % 7 = 3 THEN ' @2025-13-45T99:00:00'
         WHEN doc_id % 3 = 0 THEN ' //see ' || source || ' @2025-01-27T10:30:00'
         WHEN doc_id % 3 = 1 THEN ' @2025-01-27T10:30:00.25' ELSE '' END AS tail
  FROM documents),
lines AS (
  SELECT doc_id AS note_id, head || text || tail AS raw_text FROM dressed
  UNION ALL SELECT -1 - doc_id, head || tail FROM dressed WHERE doc_id % 13 = 5)"""

_SQL_TS = r"@(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)"

SQL_PARSED = SQL_LINES + rf""",
found AS (
  SELECT note_id, raw_text,
    list_filter(list_transform(regexp_extract_all(raw_text, '#([a-zA-Z_][a-zA-Z0-9_]*)', 1),
      lambda t, i: CASE WHEN list_position(regexp_extract_all(raw_text, '#([a-zA-Z_][a-zA-Z0-9_]*)', 1), t) = i
                   THEN t END), lambda t: t IS NOT NULL) AS tags,
    CASE WHEN regexp_matches(raw_text, '//(.+)')
         THEN {sql_strip("regexp_extract(raw_text, '//(.+)', 1)")} END AS comment,
    nullif(regexp_extract(raw_text, '{_SQL_TS}', 1), '') AS ts
  FROM lines),
untagged AS (
  SELECT *, list_reduce(list_prepend(raw_text, tags),
      lambda acc, t: regexp_replace(acc, '#' || t || '{SQL_WS}*', '', 'g')) AS b1 FROM found),
uncommented AS (
  SELECT *, CASE WHEN comment IS NOT NULL AND comment <> ''
     THEN regexp_replace(b1, '//' || regexp_escape(comment) || '{SQL_WS}*', '', 'g') ELSE b1 END AS b2 FROM untagged),
bodies AS (
  SELECT *, {sql_squeeze(f"CASE WHEN ts IS NOT NULL THEN regexp_replace(b2, '@' || regexp_escape(ts) || '{SQL_WS}*', '', 'g') ELSE b2 END")} AS body
  FROM uncommented),
parsed AS (
  SELECT note_id, raw_text, tags, comment, body, coalesce(ts, '{RUN_TS}') AS timestamp, ts,
    list_filter([
      CASE WHEN len(tags) > 10 THEN 'Too many tags: ' || len(tags) || ' > 10' END,
      CASE WHEN body = '' THEN 'Body is required but empty' END,
      CASE WHEN ts IS NOT NULL AND try_cast(ts AS TIMESTAMP) IS NULL THEN 'Invalid timestamp format: ' || ts END],
      lambda x: x IS NOT NULL) AS issues,
    list_filter([
      CASE WHEN length(body) > 1000 THEN 'Body too long: ' || length(body) || ' > 1000' END,
      CASE WHEN length(comment) > 200 THEN 'Comment too long: ' || length(comment) || ' > 200' END],
      lambda x: x IS NOT NULL) AS warnings
  FROM bodies),
checked AS (
  SELECT *, len(issues) = 0 AS valid,
    round_even(greatest(0.0::DOUBLE, 1.0::DOUBLE - (2 * len(issues) + len(warnings)) / 10.0::DOUBLE), 3)::DOUBLE AS quality
  FROM parsed)"""


# --- vectors with labels ----------------------------------------------------

def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("note_id"), F.col("embedding").alias("vector"),
        F.col("label").cast("string").alias("true_tag"))


def centroid_tags(vectors: DataFrame, threshold: float = VECTOR_THRESHOLD) -> DataFrame:
    """One tag per label: the mean vector of its notes."""
    from notemill.operators.embedding import mean_vectors

    return mean_vectors(vectors, "true_tag").select(
        F.col("true_tag").alias("tag"), "vector", F.lit(threshold).alias("confidence_threshold"),
        F.concat(F.lit("notes labelled "), "true_tag").alias("description"),
        F.array(F.lit("mean of"), F.col("n_examples").cast("string")).alias("examples"))


SQL_CENTROIDS = """
cells AS (
  SELECT vec_id AS note_id, label::VARCHAR AS true_tag, unnest(embedding::DOUBLE[]) AS v,
         generate_subscripts(embedding, 1) AS pos FROM embeddings),
centroids AS (
  SELECT tag, list(v ORDER BY pos) AS vector
  FROM (SELECT true_tag AS tag, pos, avg(v) AS v FROM cells GROUP BY 1, 2) GROUP BY tag)"""


def sql_ranked(notes: str = "SELECT vec_id AS note_id, embedding::DOUBLE[] AS v, label::VARCHAR AS true_tag FROM embeddings",
               tags: str = "SELECT tag, vector AS tv FROM centroids", threshold: float = VECTOR_THRESHOLD,
               name: str = "") -> str:
    """CTEs ranked{name} and routed{name}: cosine of every note with every tag, best first."""
    return f"""
ranked{name} AS (
  SELECT note_id, true_tag, tag, sim, row_number() OVER (PARTITION BY note_id ORDER BY round(sim, 12) DESC, tag) AS rank
  FROM (SELECT n.note_id, n.true_tag, t.tag,
          CASE WHEN list_inner_product(n.v, n.v) = 0 OR list_inner_product(t.tv, t.tv) = 0 THEN 0.0::DOUBLE
          ELSE list_inner_product(n.v, t.tv) / sqrt(list_inner_product(n.v, n.v)) / sqrt(list_inner_product(t.tv, t.tv)) END AS sim
        FROM ({notes}) n, ({tags}) t)),
routed{name} AS (
  SELECT note_id, true_tag, tag AS routed_tag, sim,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN sim >= {threshold}::DOUBLE
      THEN 0.5 + 0.5 * (sim - {threshold}::DOUBLE) / (1.0 - {threshold}::DOUBLE)
      ELSE 0.5 * sim / {threshold}::DOUBLE END)) AS conf
  FROM ranked{name} WHERE rank = 1)"""


SQL_ROUTED = SQL_CENTROIDS + "," + sql_ranked()


# --- hashed text vectors ----------------------------------------------------

def sql_hashed(name: str, source: str, dim: int = HASH_DIM) -> str:
    """CTE {name}(id, v): dense token counts over md5 buckets of ``source`` (id, text)."""
    return f"""
{name}_tok AS (SELECT id, unnest({sql_words('lower(text)')}) AS t FROM ({source})),
{name}_cnt AS (
  SELECT id, ('0x' || substr(md5(t), 1, 7))::BIGINT % {dim} AS bucket, count(*)::DOUBLE AS c
  FROM {name}_tok GROUP BY 1, 2),
{name}_ids AS (SELECT id, unnest(range({dim})) AS bucket FROM ({source})),
{name}_raw AS (
  SELECT i.id, list(coalesce(c.c, 0.0::DOUBLE) ORDER BY i.bucket) AS v
  FROM {name}_ids i LEFT JOIN {name}_cnt c ON i.id = c.id AND i.bucket = c.bucket GROUP BY i.id),
{name} AS (
  SELECT id, CASE WHEN list_inner_product(v, v) = 0 THEN v
             ELSE list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) END AS v FROM {name}_raw)"""


# --- telemetry --------------------------------------------------------------

def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: component from the user, duration from the value, error flag from the type."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("timestamp"),
        F.concat(F.lit("component_"), (F.col("user_id") % 6).cast("string")).alias("component"),
        F.concat(F.lit("type_"), (F.col("user_id") % 4).cast("string")).alias("error_type"),
        F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"), "user_id",
        (F.col("event_type") == "error").alias("is_error"))


SQL_TELEMETRY = """
telemetry AS (
  SELECT event_id, ts AS timestamp, 'component_' || (user_id % 6) AS component, 'type_' || (user_id % 4) AS error_type,
         event_type AS operation, value AS duration_ms, user_id, event_type = 'error' AS is_error FROM events),
errors AS (SELECT * FROM telemetry WHERE is_error)"""


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).filter("is_error")


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select(
        "event_id", "timestamp", (F.col("user_id") % 100).cast("double").alias("cpu_percent"),
        (F.col("user_id") * 10).cast("double").alias("memory_mb"), F.col("duration_ms").alias("processing_time_ms"),
        (F.col("event_id") % 50).cast("double").alias("throughput_notes_per_second"),
        F.col("is_error").cast("double").alias("error_rate"))


# --- notes to validate ------------------------------------------------------

def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as notes, some with a bad id or timestamp; and further notes without a usable text."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    fields = [
        F.when(d % 11 == 3, F.concat(F.lit("bad id "), d.cast("string")))
        .otherwise(F.concat(F.lit("doc_"), d.cast("string"))).alias("note_id"),
        F.when(d % 17 == 1, F.lit("yesterday")).when(d % 17 == 2, F.lit(None).cast("string"))
        .otherwise(F.lit("2025-01-27T10:30:00")).alias("timestamp")]
    faulty = (F.when(d % 19 == 2, F.lit(" \t ")).when(d % 19 == 3, F.lit("!!"))
              .when(d % 19 == 4, F.repeat(F.lit("a"), 12)).alias("text"))   # and one without any
    more = docs.filter((d % 19).between(1, 4)).select((-1 - d).alias("doc_id"), "source", *fields, faulty)
    return docs.select("doc_id", "source", *fields, "text").unionByName(more)


SQL_NOTES = """
fields AS (
  SELECT doc_id, source, text, CASE WHEN doc_id % 11 = 3 THEN 'bad id ' || doc_id ELSE 'doc_' || doc_id END AS note_id,
    CASE WHEN doc_id % 17 = 1 THEN 'yesterday' WHEN doc_id % 17 = 2 THEN NULL ELSE '2025-01-27T10:30:00' END AS timestamp FROM documents),
notes AS (
  SELECT doc_id, source, note_id, timestamp, text FROM fields
  UNION ALL SELECT -1 - doc_id, source, note_id, timestamp,
    CASE WHEN doc_id % 19 = 2 THEN ' ' || chr(9) || ' ' WHEN doc_id % 19 = 3 THEN '!!' WHEN doc_id % 19 = 4 THEN repeat('a', 12) END
  FROM fields WHERE doc_id % 19 BETWEEN 1 AND 4)"""

SQL_CHECKED_NOTES = SQL_NOTES + rf""",
judged AS (
  SELECT *,
    list_filter([
      CASE WHEN text IS NULL THEN 'missing_field' END,
      CASE WHEN length(text) < 3 THEN 'length_error' END,
      CASE WHEN note_id IS NULL THEN 'missing_field' END,
      CASE WHEN NOT regexp_matches(note_id, '^[a-zA-Z0-9_-]+$') THEN 'pattern_error' END,
      CASE WHEN timestamp IS NULL THEN 'missing_field' END,
      CASE WHEN NOT regexp_matches(timestamp, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?$') THEN 'pattern_error' END,
      CASE WHEN {sql_strip('text')} = '' THEN 'content_error' END], lambda x: x IS NOT NULL) AS errors,
    list_filter([
      CASE WHEN length(text) > 10000 THEN 'Maximum length is 10000, got ' || length(text) END,
      CASE WHEN length(note_id) > 100 THEN 'Maximum length is 100, got ' || length(note_id) END,
      CASE WHEN {sql_strip('text')} = '' THEN 'Only white space' END,
      CASE WHEN NOT regexp_matches(text, '[\p{{L}}\p{{N}}_]|{SQL_WS}') THEN 'Neither letters nor digits' END,
      CASE WHEN substr(text, 1, 1) <> chr(10) AND substr(text, 1, 11) = repeat(substr(text, 1, 1), 11) THEN 'One character repeated' END,
      CASE WHEN length(text) < 10 THEN 'Hardly any text' END], lambda x: x IS NOT NULL) AS warnings
  FROM notes),
checked_notes AS (
  SELECT *, len(errors) = 0 AS is_valid,
    round_even(greatest(0.0::DOUBLE, 1.0::DOUBLE - (2 * len(errors) + len(warnings)) / 10.0::DOUBLE), 3)::DOUBLE AS quality
  FROM judged)"""
