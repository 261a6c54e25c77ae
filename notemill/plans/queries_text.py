"""Registered queries over texts: normalising, parsing, cleaning, validating, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.operators import notes as nt
from notemill.operators import rules as ru
from notemill.operators import recommendations as rec
from notemill.operators import validation as va
from notemill.operators.ordering import round_robin
from notemill.plans import flows as fl
from notemill.plans import inputs as inp
from notemill.plans.inputs import table
from notemill.runtime import scratch_path
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


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


# --- notes ------------------------------------------------------------------

@_query("normalize_text", f"""
SELECT 'd' || doc_id AS note_id, {inp.sql_normalize('text')} AS text FROM documents
UNION ALL SELECT 'c' || conv_id || '_' || turn, {inp.sql_normalize('text')} FROM conversations""")
def normalize_text(spark, sf):
    docs = _docs(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("note_id"), "text")
    talk = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("note_id"),
        "text")
    return docs.unionByName(talk).withColumn("text", tx.normalize_text(F.col("text")))


@_query("dedup_first", f"""
SELECT doc_id, source, text FROM (
  SELECT doc_id, source, {inp.sql_normalize('text')} AS text,
         row_number() OVER (PARTITION BY {inp.sql_normalize('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_first(spark, sf):
    notes = _docs(spark, sf).select("doc_id", "source", tx.normalize_text(F.col("text")).alias("text"))
    return nt.deduplicate_notes(notes, "doc_id")


@_query("length_filter", f"""
SELECT doc_id, len({inp.sql_words('text')}) AS words FROM documents WHERE len({inp.sql_words('text')}) BETWEEN 3 AND 500""")
def length_filter(spark, sf):
    return nt.filter_by_length(_docs(spark, sf)).select("doc_id", tx.word_count(F.col("text")).alias("words"))


@_query("text_counts", f"""
SELECT lang, source, count(*) AS notes, sum(len({inp.sql_words('text')})) AS words, sum(length(text)) AS chars
FROM documents GROUP BY lang, source""")
def text_counts(spark, sf):
    return _docs(spark, sf).groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("notes"), F.sum(tx.word_count(F.col("text"))).alias("words"),
        F.sum(F.length("text")).alias("chars"))


# --- capture grammar --------------------------------------------------------

def _parsed(spark, sf):
    return nt.parse_capture(inp.capture_lines(spark, sf), run_ts=inp.RUN_TS)


@_query("parse_capture", f"""WITH {inp.SQL_PARSED}
SELECT note_id, array_to_string(tags, ',') AS tags, comment, timestamp, body, valid,
       array_to_string(issues, '|') AS issues, array_to_string(warnings, '|') AS warnings, quality,
       ts IS NULL AS auto_timestamped FROM checked""")
def parse_capture(spark, sf):
    return _parsed(spark, sf).select(
        "note_id", F.array_join("tags", ",").alias("tags"), "comment", "timestamp", "body", "valid",
        F.array_join("issues", "|").alias("issues"), F.array_join("warnings", "|").alias("warnings"), "quality",
        F.map_contains_key("metadata", F.lit("auto_timestamped")).alias("auto_timestamped"))


_FAN_OUT = f"""WITH {inp.SQL_PARSED}
SELECT note_id, unnest(CASE WHEN len(tags) = 0 THEN ['untagged'] ELSE tags END) AS tag, body, comment, timestamp, valid,
       array_to_string(issues, '|') AS issues, array_to_string(tags, ',') AS all_tags FROM checked"""


def _flat_fan_out(rows: DataFrame) -> DataFrame:
    return rows.withColumn("issues", F.array_join("issues", "|")).withColumn(
        "all_tags", F.array_join("all_tags", ",")).drop("metadata")


@_query("fanout_by_tag", _FAN_OUT)
def fanout_by_tag(spark, sf):
    return _flat_fan_out(nt.fan_out(_parsed(spark, sf)))


@_query("fanout_sink", _FAN_OUT.replace("SELECT note_id, unnest", "SELECT unnest"))
def fanout_sink(spark, sf):
    path = scratch_path(spark, "by_tag")
    wr.write_by_tag(_parsed(spark, sf), path)
    return _flat_fan_out(wr.read_by_tag(spark, path)).drop("tag_dir")


@_query("record_roundtrip", f"""WITH {inp.SQL_PARSED}
SELECT array_to_string(tags, ',') AS tags, body, comment, timestamp, raw_text, valid,
       array_to_string(issues, '|') AS issues FROM checked""")
def record_roundtrip(spark, sf):
    back = wr.from_record(wr.to_record(_parsed(spark, sf)))
    return back.select(F.array_join("tags", ",").alias("tags"), "body", "comment", "timestamp", "raw_text", "valid",
                       F.array_join("issues", "|").alias("issues"))


@_query("capture_stats", f"""WITH {inp.SQL_PARSED}
SELECT count(*) AS total_notes, count(*) FILTER (valid) AS valid_notes, count(*) FILTER (NOT valid) AS invalid_notes,
       count(*) FILTER (len(tags) > 0) AS notes_with_tags,
       count(*) FILTER (comment IS NOT NULL AND comment <> '') AS notes_with_comments,
       round(avg(len(tags)), 6) AS avg_tags_per_note FROM checked""")
def capture_stats(spark, sf):
    stats = nt.capture_stats(_parsed(spark, sf))
    return stats.withColumn("avg_tags_per_note", F.round("avg_tags_per_note", 6))


@_query("invalid_captures", f"""WITH {inp.SQL_PARSED}
SELECT note_id, array_to_string(issues, '|') AS issues FROM checked WHERE NOT valid""")
def invalid_captures(spark, sf):
    return nt.split_valid(_parsed(spark, sf))[1].select("note_id", F.array_join("issues", "|").alias("issues"))


@_query("ingestion_metrics", f"""WITH {inp.SQL_PARSED}
SELECT CASE WHEN len(tags) = 0 THEN 'untagged' ELSE tags[1] END AS source_type, count(*) AS volume,
       sum(length(raw_text)) AS total_size, count(*) FILTER (valid) AS success_count,
       count(*) FILTER (NOT valid) AS error_count FROM checked GROUP BY 1""")
def ingestion_metrics(spark, sf):
    from notemill.operators.observability import ingestion_metrics as metrics

    rows = _parsed(spark, sf).withColumn("source_type", F.coalesce(F.get("tags", F.lit(0)), F.lit("untagged")))
    return metrics(rows, "source_type", "raw_text", F.col("valid"))


# --- cleaning ---------------------------------------------------------------

@_query("clean_html", f"""
SELECT page_id, {inp.sql_squeeze("regexp_replace(html, '<[^>]*>', '', 'g')")} AS text,
       lower({inp.sql_squeeze("regexp_replace(html, '<[^>]*>', '', 'g')")}) AS lowered FROM pages""")
def clean_html(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", tx.clean_text(F.col("html")).alias("text"), tx.clean_text(F.col("html"), lowercase=True).alias("lowered"))


_PUNCT = "chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212)"


@_query("normalize_content", rf"""
SELECT doc_id, replace(translate(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'),
   {_PUNCT}, '''''""--'), chr(8230), '...') AS content FROM documents""")
def normalize_content(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.normalize_content(F.col("text")).alias("content"))


@_query("sanitize_content", r"""
SELECT page_id, replace(replace(replace(replace(
   regexp_replace(regexp_replace(html, '(?is)<script.*?</script\s*>', '', 'g'), '(?i)<script[^>]*>|javascript:|data:', '', 'g'),
   '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS content FROM pages""")
def sanitize_content(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.sanitize_content(F.col("html")).alias("content"))


@_query("sanitize_bytes", r"""
WITH raw AS (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN '<script>x</script >' || chr(65533) || text || chr(65533) ELSE text END AS t FROM documents)
SELECT doc_id, doc_id % 5 <> 2 AS valid, md5(replace(replace(replace(replace(
   regexp_replace(regexp_replace(t, '(?is)<script.*?</script\s*>', '', 'g'), '(?i)<script[^>]*>|javascript:|data:', '', 'g'),
   '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM raw""")
def sanitize_bytes(spark, sf):
    """Documents as bytes, every fifth with bytes that are not UTF-8."""
    raw = F.encode("text", "UTF-8")
    broken = F.concat(F.encode(F.lit("<script>x</script >"), "UTF-8"), F.lit(b"\xff"), raw, F.lit(b"\xc3"))
    read = table(spark, sf, "documents").select(
        "doc_id", tx.sanitize_bytes(F.when(F.col("doc_id") % 5 == 2, broken).otherwise(raw)).alias("s"))
    return read.select("doc_id", "s.valid", F.md5("s.content").alias("digest"))


@_query("length_batches", """
SELECT CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 500 THEN 'medium' ELSE 'long' END AS length_bucket, count(*) AS n, true AS in_order
FROM documents GROUP BY 1""")
def length_batches(spark, sf):
    """Rows of a task in the order of their length, so that a batch holds texts of about one size."""
    rows = ru.batch_by_length(_docs(spark, sf)).select(
        "length_bucket", F.length("text").alias("n_chars"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row"))
    before = F.max("n_chars").over(Window.partitionBy("task").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("ok", F.coalesce(before <= F.col("n_chars"), F.lit(True))).groupBy("length_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("in_order"))


@_query("fix_content", """
WITH cut AS (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS c FROM pages),
long AS (SELECT page_id, CASE WHEN length(c) > 10000 THEN substr(c, 1, 10000) || '...' ELSE c END AS c FROM cut)
SELECT page_id, CASE WHEN length(c) < 10 THEN c || ' [Content too short]' ELSE c END AS content FROM long""")
def fix_content(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.fix_content(F.col("html")).alias("content"))


def _sql_redact(x: str) -> str:
    for pattern, mark in tx.PII_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return x


@_query("redact_pii", f"SELECT doc_id, {_sql_redact('text')} AS text FROM documents")
def redact_pii(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.redact_pii(F.col("text")).alias("text"))


@_query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@_query("hash_mismatches", "SELECT doc_id FROM documents WHERE text <> trim(text) OR doc_id % 10 = 0")
def hash_mismatches(spark, sf):
    docs = _docs(spark, sf)
    stored = docs.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.trim("text"))
    return wr.verify_hashes(stored, docs.select("doc_id", changed.alias("content")), "doc_id").select("doc_id")


@_query("segment_text", rf"""
WITH paras AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {inp.sql_strip('p')}),
         lambda p: p <> '')) AS p, FROM documents),
pieces AS (
  SELECT doc_id, unnest(list_transform(range(0, greatest(ceil((length(p) - 100) / 900.0)::BIGINT, 1)),
         lambda i: substr(p, 1 + 900 * i, 1000))) AS segment FROM paras)
SELECT doc_id, count(*) AS segments, sum(length(segment)) AS chars, min(md5(segment)) AS first_hash,
       max(md5(segment)) AS last_hash FROM pieces GROUP BY doc_id""")
def segment_text(spark, sf):
    pieces = _docs(spark, sf).select("doc_id", F.explode(tx.segments(F.col("text"), 1000, 100)).alias("segment"))
    return pieces.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.length("segment")).alias("chars"),
        F.min(F.md5("segment")).alias("first_hash"), F.max(F.md5("segment")).alias("last_hash"))


@_query("tag_format", f"""
SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(w, lambda t, i: CASE WHEN list_position(w, t) = i THEN t END),
         lambda t: t IS NOT NULL), 1, 10), ',') AS tags
FROM (SELECT doc_id, list_filter({inp.sql_words('lower(text)')},
         lambda t: regexp_matches(t, '^[a-z0-9-]+$') AND length(t) <= 50) AS w FROM documents)""")
def tag_format(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.array_join(tx.normalize_tag_list(tx.words(F.col("text"))), ",").alias("tags"))


STOP_WORDS = {
    "de": ["der", "die", "das", "und", "nicht", "mit", "von", "ist"],
    "en": ["the", "and", "of", "to", "is", "that", "with"],
    "es": ["los", "las", "del", "que", "por", "con", "una"],
    "fr": ["les", "des", "une", "pour", "dans", "est", "qui"],
}
_SQL_HITS = ", ".join(
    "len(list_filter(w, lambda t: t IN (" + ", ".join(f"'{x}'" for x in ws) + f"))) AS h_{lang}"
    for lang, ws in sorted(STOP_WORDS.items()))


@_query("detect_language", rf"""
WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+') AS w FROM documents),
h AS (SELECT doc_id, {_SQL_HITS} FROM w),
s AS (SELECT doc_id, h_de + h_en + h_es + h_fr AS total, greatest(h_de, h_en, h_es, h_fr) AS top,
  CASE greatest(h_de, h_en, h_es, h_fr) WHEN h_de THEN 'de' WHEN h_en THEN 'en' WHEN h_es THEN 'es' ELSE 'fr' END AS best FROM h)
SELECT doc_id, round(CASE WHEN total = 0 THEN 0.0 ELSE top / total::DOUBLE END, 6) AS language_confidence,
  CASE WHEN total > 0 AND top / total::DOUBLE >= 0.8::DOUBLE THEN best ELSE 'en' END AS language FROM s""")
def detect_language(spark, sf):
    found = nt.detect_language(_docs(spark, sf).select("doc_id", "text"), STOP_WORDS)
    return found.select("doc_id", F.round("language_confidence", 6).alias("language_confidence"), "language")


# --- validation -------------------------------------------------------------

def _checked(spark, sf):
    return va.validate_notes(inp.raw_notes(spark, sf))


@_query("validate_notes", f"""WITH {inp.SQL_CHECKED_NOTES}
SELECT doc_id, note_id, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings,
       is_valid, quality FROM checked_notes""")
def validate_notes(spark, sf):
    return _checked(spark, sf).select(
        "doc_id", "note_id", F.array_join("errors.error_type", "|").alias("errors"),
        F.array_join("warnings.message", "|").alias("warnings"), "is_valid", "quality")


@_query("validate_notes_batch", f"""WITH {inp.SQL_CHECKED_NOTES.replace("notes AS (", "notes0 AS (", 1)
    .replace("judged AS (", """notes AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN source WHEN doc_id % 23 = 4 THEN NULL
    ELSE note_id END AS note_id) FROM notes0),
judged AS (""", 1)}
SELECT result_id, doc_id, is_valid, quality FROM (
  SELECT coalesce(note_id, 'note_' || doc_id) AS result_id, doc_id, is_valid, quality,
         row_number() OVER (PARTITION BY coalesce(note_id, 'note_' || doc_id) ORDER BY doc_id DESC) AS rn
  FROM checked_notes) WHERE rn = 1""")
def validate_notes_batch(spark, sf):
    notes = inp.raw_notes(spark, sf).withColumn(
        "note_id", F.when(F.col("doc_id") % 5 == 0, F.col("source"))
        .when(F.col("doc_id") % 23 == 4, F.lit(None)).otherwise(F.col("note_id")))
    return va.validate_notes_batch(notes, "doc_id").select("result_id", "doc_id", "is_valid", "quality")


@_query("validation_report", f"""WITH {inp.SQL_CHECKED_NOTES}
SELECT count(*) AS total_items, count(*) FILTER (is_valid) AS valid_items, count(*) FILTER (NOT is_valid) AS invalid_items,
       round(avg(is_valid::INT), 6) AS validation_rate, round_even(avg(quality), 3)::DOUBLE AS average_quality_score,
       sum(len(errors))::BIGINT AS total_errors, sum(len(warnings))::BIGINT AS total_warnings FROM checked_notes""")
def validation_report(spark, sf):
    return va.validation_summary(_checked(spark, sf)).withColumn("validation_rate", F.round("validation_rate", 6))


@_query("validation_error_types", f"""WITH {inp.SQL_CHECKED_NOTES}
SELECT error_type, count(*) AS count FROM (SELECT unnest(errors) AS error_type FROM checked_notes) GROUP BY 1""")
def validation_error_types(spark, sf):
    return va.error_type_counts(_checked(spark, sf))


@_query("validation_issues", f"""WITH {inp.SQL_CHECKED_NOTES}
SELECT item_id, severity, count(*) AS n FROM (
  SELECT doc_id AS item_id, 'error' AS severity, unnest(errors) AS e FROM checked_notes
  UNION ALL SELECT doc_id, 'warning', unnest(warnings) FROM checked_notes) GROUP BY 1, 2""")
def validation_issues(spark, sf):
    return va.issue_rows(_checked(spark, sf), "doc_id").groupBy("item_id", "severity").agg(
        F.count(F.lit(1)).alias("n"))


@_query("validation_recommendations", f"""WITH {inp.SQL_CHECKED_NOTES},
s AS (SELECT count(*) AS n, count(*) FILTER (NOT is_valid) AS bad, sum(len(errors)) AS e, sum(len(warnings)) AS w FROM checked_notes),
t AS (SELECT error_type, count(*) AS c FROM (SELECT unnest(errors) AS error_type FROM checked_notes) GROUP BY 1)
SELECT 'many_invalid' AS code, NULL AS about, round(bad / n::DOUBLE, 6) AS value FROM s WHERE bad / n::DOUBLE > 0.1
UNION ALL SELECT 'errors_over_warnings', NULL, round(e / w::DOUBLE, 6) FROM s WHERE e > 2 * w
UNION ALL SELECT 'frequent_error', error_type, round(c / n::DOUBLE, 6) FROM t, s WHERE c > n * 0.05""")
def validation_recommendations(spark, sf):
    checked = _checked(spark, sf)
    advice = rec.validation_recommendations(va.validation_summary(checked), va.error_type_counts(checked))
    return advice.select("code", "about", F.round("value", 6).alias("value"))


@_query("length_outliers", f"""WITH {inp.SQL_NOTES},
s AS (SELECT avg(length(text)) AS mean, stddev_pop(length(text)) AS std FROM notes)
SELECT note_id, 'text' AS field, length(text)::DOUBLE AS field_value, round(abs(length(text) - mean), 4) AS deviation,
       round(2 * std, 4) AS threshold FROM notes, s WHERE abs(length(text) - mean) > 2 * std""")
def length_outliers(spark, sf):
    out = va.detect_outliers(inp.raw_notes(spark, sf))
    return out.select("note_id", "field", "field_value", F.round("deviation", 4).alias("deviation"),
                      F.round("threshold", 4).alias("threshold"))


@_query("input_summary", f"""WITH {inp.SQL_CHECKED_NOTES},
s AS (SELECT avg(length(text)) AS mean, stddev_pop(length(text)) AS std FROM notes),
o AS (SELECT count(*) AS outliers FROM notes, s WHERE abs(length(text) - mean) > 2 * std)
SELECT 'notes' AS kind, count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid,
       round(avg(quality), 6) AS avg_quality_score, (SELECT outliers FROM o) AS outliers FROM checked_notes""")
def input_summary(spark, sf):
    notes = inp.raw_notes(spark, sf)
    summary = va.input_summary(va.validate_notes(notes), va.detect_outliers(notes), "notes")
    return summary.withColumn("avg_quality_score", F.round("avg_quality_score", 6))


def _benchmark_tags(spark, sf):
    """Benchmark items as tag definitions: the lines of the text are the examples; some are faulty."""
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        "item_id",
        F.when(i % 9 == 2, F.concat(F.lit("Item "), i.cast("string"))).when(i % 31 == 7, F.lit(""))
        .otherwise(F.concat(F.lit("item_"), i.cast("string"))).alias("tag"),
        F.when(i % 8 == 3, F.lit("short")).otherwise(F.col("text")).alias("description"),
        F.when(i % 10 == 4, F.array().cast("array<string>")).otherwise(F.split("text", " ")).alias("examples"),
        ((i % 26) / F.lit(20.0) - F.lit(0.1)).alias("confidence_threshold"))


_SQL_TAGS = """
tags AS (
  SELECT item_id, CASE WHEN item_id % 9 = 2 THEN 'Item ' || item_id WHEN item_id % 31 = 7 THEN ''
         ELSE 'item_' || item_id END AS tag,
    CASE WHEN item_id % 8 = 3 THEN 'short' ELSE text END AS description,
    CASE WHEN item_id % 10 = 4 THEN [] ELSE string_split(text, ' ') END AS examples,
    (item_id % 26) / 20.0::DOUBLE - 0.1::DOUBLE AS threshold FROM benchmark)"""


@_query("validate_tags", f"""WITH {_SQL_TAGS},
j AS (SELECT item_id,
  list_filter([
    CASE WHEN NOT regexp_matches(tag, '^[a-z_][a-z0-9_]*$') THEN 'tag:pattern_error' END,
    CASE WHEN length(description) < 10 THEN 'description:length_error' END,
    CASE WHEN len(examples) < 1 THEN 'examples:count_error' END,
    CASE WHEN threshold < 0 THEN 'confidence_threshold:value_error' END,
    CASE WHEN threshold > 1 THEN 'confidence_threshold:value_error' END], lambda x: x IS NOT NULL) AS errors,
  (length(tag) > 50)::INT + (length(description) > 1000)::INT + (len(examples) > 20)::INT AS field_warnings,
  len(list_filter(list_transform(examples, lambda e, i: list_position(examples, e) < i), lambda b: b)) AS duplicates,
  len(list_filter(examples, lambda e: length({inp.sql_strip('e')}) < 5)) AS shorts FROM tags)
SELECT item_id, array_to_string(errors, '|') AS errors, (field_warnings + duplicates + shorts)::BIGINT AS n_warnings,
  duplicates::BIGINT AS n_duplicates, len(errors) = 0 AS is_valid,
  round_even(greatest(0.0::DOUBLE, 1.0::DOUBLE - (2 * len(errors) + field_warnings + duplicates + shorts) / 10.0::DOUBLE), 3)::DOUBLE AS quality FROM j""")
def validate_tags(spark, sf):
    checked = va.validate_tags(_benchmark_tags(spark, sf))
    name = F.transform("errors", lambda e: F.concat(e["field"], F.lit(":"), e["error_type"]))
    return checked.select(
        "item_id", F.array_join(name, "|").alias("errors"), F.size("warnings").cast("long").alias("n_warnings"),
        F.size(F.filter("warnings", lambda w: w["error_type"] == "duplicate_warning")).cast("long").alias("n_duplicates"),
        "is_valid", "quality")


@_query("ontology_problems", f"""WITH {_SQL_TAGS}
SELECT tag, 'Tag name is empty' AS problem FROM tags WHERE tag = ''
UNION ALL SELECT tag, 'Tag ''' || tag || ''' has no examples' FROM tags WHERE len(examples) = 0
UNION ALL SELECT tag, 'Tag ''' || tag || ''' has invalid confidence threshold' FROM tags WHERE threshold < 0 OR threshold > 1""")
def ontology_problems(spark, sf):
    found = va.ontology_problems(_benchmark_tags(spark, sf))
    return found.withColumn("problem", F.regexp_replace("problem", "threshold: .*", "threshold"))


@_query("validate_content", """
WITH j AS (SELECT page_id, list_filter([
  CASE WHEN html = '' THEN 'Required field ''html'' is missing or empty' END,
  CASE WHEN length(html) < 10 THEN 'Content too short (minimum 10 characters)'
       WHEN length(html) > 10000 THEN 'Content too long (maximum 10000 characters)' END,
  CASE WHEN regexp_matches(html, '(?i)<script>|javascript:|data:') THEN 'Content contains invalid characters or format' END],
  lambda x: x IS NOT NULL) AS e FROM pages)
SELECT page_id, array_to_string(e, '|') AS errors, len(e) = 0 AS content_valid FROM j""")
def validate_content(spark, sf):
    checked = va.validate_content(table(spark, sf, "pages"), "html", ("html",))
    return checked.select("page_id", F.array_join("content_errors", "|").alias("errors"), "content_valid")


@_query("field_rules", """
SELECT conv_id, turn, role IN ('user', 'system') AS known_role, turn BETWEEN 0 AND 3 AS early,
  regexp_matches(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' ||
     substr(h, 21, CASE WHEN conv_id % 2 = 0 THEN 12 ELSE 11 END), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS uuid_ok
FROM (SELECT *, md5(text) AS h FROM conversations)""")
def field_rules(spark, sf):
    h, tail = F.md5("text"), F.when(F.col("conv_id") % 2 == 0, 12).otherwise(11)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
                       F.substring(h, F.lit(21), tail))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", va.one_of(F.col("role"), ["user", "system"]).alias("known_role"),
        va.in_range(F.col("turn"), 0, 3).alias("early"), va.valid_uuid(uuid).alias("uuid_ok"))


# --- rules ------------------------------------------------------------------

RULES = {
    "english": (0.6, ["the", "and", "of", "to", "is"]),
    "german": (0.5, ["der", "die", "und", "nicht"]),
    "mixed": (0.25, ["the", "der", "que", "des", "un", "con", "for", "zu"]),
}


def _sql_rules() -> str:
    parts = [
        "struct_pack(neg := -len(list_intersect(w, [" + ", ".join(f"'{x}'" for x in ws) + f"])) / {float(len(ws))}::DOUBLE, "
        f"category := '{c}', thr := {t}::DOUBLE)" for c, (t, ws) in RULES.items()]
    return "[" + ", ".join(parts) + "]"


@_query("keyword_rules", f"""
WITH w AS (SELECT doc_id, {inp.sql_words(inp.sql_normalize('text'))} AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_filter({_sql_rules()}, lambda s: -s.neg >= s.thr)) AS hits FROM w)
SELECT doc_id, array_to_string(list_transform(hits, lambda s: s.category), ',') AS categories,
  coalesce(hits[1].category, 'general') AS category FROM s""")
def keyword_rules(spark, sf):
    found = ru.classify_by_keywords(_docs(spark, sf).select("doc_id", "text"), rules=RULES)
    return found.select("doc_id", F.array_join("categories", ",").alias("categories"), "category")


@_query("keyword_tags", """
SELECT doc_id, array_to_string(list_concat([lang], list_filter([CASE WHEN contains(text, 'the') THEN 'the' END,
  CASE WHEN contains(text, 'token') THEN 'token' END, CASE WHEN contains(text, 'License') THEN 'License' END],
  lambda x: x IS NOT NULL)), ',') AS tags FROM documents""")
def keyword_tags(spark, sf):
    found = ru.keyword_tags(F.col("text"), ["the", "token", "License"])
    return _docs(spark, sf).select("doc_id", F.array_join(ru.append_tags(F.array("lang"), found), ",").alias("tags"))


_MAPPING = {"english": ["the", "and"], "german": ["der", "und"], "romance": ["que", "des", "los"]}


@_query("category_mapping", f"""
WITH w AS (SELECT doc_id, {inp.sql_words(inp.sql_normalize('text'))} AS w FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN list_has_any(w, ['the', 'and']) THEN 'english' END,
  CASE WHEN list_has_any(w, ['der', 'und']) THEN 'german' END,
  CASE WHEN list_has_any(w, ['que', 'des', 'los']) THEN 'romance' END) AS categories FROM w""")
def category_mapping(spark, sf):
    mapped = ru.map_categories(_docs(spark, sf).select("doc_id", "text"), mapping=_MAPPING)
    return mapped.select("doc_id", F.array_join("categories", ",").alias("categories"))


@_query("rule_routing", """
SELECT doc_id,
  CASE WHEN source = 'src3' OR contains(text, 'token') THEN 'r2' WHEN lang = 'en' AND n_chars > 1000 THEN 'r1'
       WHEN regexp_matches(text, '[0-9]{5,}') THEN 'r3' END AS rule_id,
  CASE WHEN source = 'src3' OR contains(text, 'token') THEN 'review' WHEN lang = 'en' AND n_chars > 1000 THEN 'long_english'
       WHEN regexp_matches(text, '[0-9]{5,}') THEN 'numbers' ELSE 'default' END AS destination,
  concat_ws(',', CASE WHEN source = 'src3' OR contains(text, 'token') THEN 'r2' END,
    CASE WHEN lang = 'en' AND n_chars > 1000 THEN 'r1' END, CASE WHEN regexp_matches(text, '[0-9]{5,}') THEN 'r3' END) AS matched
FROM documents""")
def rule_routing(spark, sf):
    rules = [
        ru.Rule("r1", [ru.Condition("lang", "equals", "en"), ru.Condition("n_chars", "greater_than", 1000)],
                "long_english", 2),
        ru.Rule("r2", [ru.Condition("source", "equals", "src3"), ru.Condition("text", "contains", "token", "OR")],
                "review", 5),
        ru.Rule("r3", [ru.Condition("text", "regex", "[0-9]{5,}")], "numbers", 1),
        ru.Rule("r4", [ru.Condition("lang", "equals", "de")], "never", 9, enabled=False),
    ]
    out = ru.apply_rules(_docs(spark, sf), rules)
    return out.select("doc_id", "rule_id", "destination", F.array_join("matched_rules", ",").alias("matched"))


@_query("size_routing", """
SELECT CASE WHEN n_chars > 10000 THEN 'batch_processor' WHEN n_chars > 1000 THEN 'standard_processor' ELSE 'fast_processor' END AS processor,
  CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 500 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n
FROM documents GROUP BY 1, 2""")
def size_routing(spark, sf):
    return _docs(spark, sf).groupBy(
        ru.route_by_size(F.col("n_chars")).alias("processor"), ru.length_bucket(F.col("text")).alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


@_query("category_routing", """
WITH c AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'work' WHEN 'de' THEN 'research' WHEN 'fr' THEN 'learning' ELSE 'other' END AS category,
  (doc_id % 100) / 100.0::DOUBLE AS score, source FROM documents)
SELECT doc_id, CASE WHEN score >= 0.7::DOUBLE THEN category ELSE 'general' END AS accepted,
  CASE CASE WHEN score >= 0.7::DOUBLE THEN category ELSE 'general' END WHEN 'research' THEN 'research_storage' WHEN 'personal' THEN 'personal_storage'
    WHEN 'work' THEN 'work_storage' WHEN 'learning' THEN 'learning_storage' ELSE 'general_storage' END AS storage,
  CASE WHEN source IN ('src1', 'src2') THEN source WHEN category IN ('work', 'research') THEN category ELSE 'archive' END AS fallback,
  CASE WHEN score > 0.9::DOUBLE THEN 'priority_queue' WHEN score < 0.1::DOUBLE THEN 'background_processor' ELSE 'standard_queue' END AS queue
FROM c""")
def category_routing(spark, sf):
    lang, score = F.col("lang"), (F.col("doc_id") % 100) / F.lit(100.0)
    category = F.when(lang == "en", "work").when(lang == "de", "research").when(lang == "fr", "learning").otherwise("other")
    accepted = ru.accept_prediction(category, score)
    priority = F.when(score > 0.9, "high").when(score < 0.1, "low").otherwise("normal")
    return _docs(spark, sf).select(
        "doc_id", accepted.alias("accepted"), ru.route_by_category(accepted).alias("storage"),
        ru.fallback_destination(F.col("source"), category, valid=["src1", "src2", "work", "research"],
                                default="archive").alias("fallback"),
        ru.route_by_priority(priority).alias("queue"))


@_query("time_routing", """
SELECT CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 'business_processor' ELSE 'background_processor' END AS by_hour,
  CASE WHEN ts < TIMESTAMP '2024-01-15 01:00:00' THEN 'urgent_processor' WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'priority_processor'
       ELSE 'standard_processor' END AS by_deadline, count(*) AS n FROM events GROUP BY 1, 2""")
def time_routing(spark, sf):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf, "events").groupBy(
        ru.route_by_time_of_day(F.col("ts")).alias("by_hour"), ru.route_by_deadline(F.col("ts"), now).alias("by_deadline")
    ).agg(F.count(F.lit(1)).alias("n"))


_WEIGHTS = [("alpha", 5.0), ("beta", 3.0), ("gamma", 2.0)]


@_query("weighted_destination", """
WITH r AS (SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 1, 7))::BIGINT / 268435456.0::DOUBLE * 10.0::DOUBLE AS r FROM events)
SELECT event_id, CASE WHEN r < 5.0 THEN 'alpha' WHEN r < 8.0 THEN 'beta' ELSE 'gamma' END AS destination FROM r""")
def weighted_destination(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", ru.weighted_destination(F.col("event_id"), _WEIGHTS).alias("destination"))


@_query("round_robin", """
SELECT doc_id, ['alpha', 'beta', 'gamma'][((row_number() OVER (ORDER BY lang, doc_id) - 1) % 3 + 1)::INT] AS destination FROM documents""")
def round_robin_labels(spark, sf):
    return round_robin(_docs(spark, sf).select("lang", "doc_id"), ["lang", "doc_id"], ["alpha", "beta", "gamma"],
                       "destination").select("doc_id", "destination")


# --- chains -----------------------------------------------------------------

@_query("staged_run", f"""
WITH n AS (SELECT doc_id, {inp.sql_normalize('text')} AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN t = '' THEN 'normalize' WHEN len({inp.sql_words('t')}) < 20 THEN 'length'
  WHEN length(t) > 10000 THEN 'size' END AS failed_stage FROM n)
SELECT doc_id, failed_stage, failed_stage IS NULL AS success FROM s""")
def staged_run(spark, sf):
    stages = [
        fl.Stage("normalize", lambda d: d.withColumn("text", tx.normalize_text(F.col("text"))), F.col("text") == ""),
        fl.Stage("length", lambda d: d.withColumn("words", tx.word_count(F.col("text"))), F.col("words") < 20),
        fl.Stage("size", lambda d: d, F.length("text") > 10_000),
    ]
    return fl.run_stages(_docs(spark, sf).select("doc_id", "text"), stages).select("doc_id", "failed_stage", "success")


@_query("plugin_chain", f"""
SELECT doc_id, {inp.sql_squeeze("lower(regexp_replace(text, '[0-9]', '', 'g'))")} AS text FROM documents""")
def plugin_chain(spark, sf):
    return fl.plugin_chain(_docs(spark, sf).select("doc_id", "text"), [
        lambda d: d.withColumn("text", F.regexp_replace("text", "[0-9]", "")),
        lambda d: d.withColumn("text", F.lower("text")),
        lambda d: d.withColumn("text", tx.squeeze_ws(F.col("text"))),
    ])
