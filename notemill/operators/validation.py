"""Validation rules as arrays of issues computed in one pass, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.functions.scoring import quality_score
from notemill.operators.notes import keep_last

# Note rules.
NOTE_TEXT_LENGTH = (3, 10_000)
NOTE_ID_PATTERN = r"^[a-zA-Z0-9_-]+$"
NOTE_ID_MAX = 100
NOTE_TS_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"
# Tag rules.
TAG_NAME_PATTERN = r"^[a-z_][a-z0-9_]*$"
TAG_NAME_MAX = 50
TAG_DESCRIPTION_LENGTH = (10, 1000)
TAG_EXAMPLES_COUNT = (1, 20)
TAG_THRESHOLD_RANGE = (0.0, 1.0)
# Content rules.
CONTENT_LENGTH = (10, 10_000)
PROHIBITED_PATTERNS = ("<script>", "javascript:", "data:")
ALLOWED_CONTENT = rf"[^{tx.WORD}\s.,!?()\[\]{{}}:;'\"-]"

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

_ISSUE_TYPE = "array<struct<field:string,error_type:string,message:string,value:string,severity:string>>"


def issue(cond: Column, field, error_type: str, message, value: Column, severity: str = "error") -> Column:
    """The issue struct when ``cond`` holds, else NULL."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(cond, F.struct(
        as_col(field).alias("field"), F.lit(error_type).alias("error_type"),
        as_col(message).alias("message"), value.cast("string").alias("value"),
        F.lit(severity).alias("severity"),
    ))


def issue_array(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues)).cast(_ISSUE_TYPE)


def _missing(field: str, c: Column) -> Column:
    return issue(c.isNull(), field, "missing_field", f"Required field '{field}' is missing", c)


def _too_short(field: str, c: Column, low: int) -> Column:
    return issue(F.length(c) < low, field, "length_error",
                 F.format_string(f"Minimum length is {low}, got %d", F.length(c)), c)


def _too_long(field: str, c: Column, high: int) -> Column:
    return issue(F.length(c) > high, field, "length_warning",
                 F.format_string(f"Maximum length is {high}, got %d", F.length(c)), c, "warning")


def _mismatch(field: str, c: Column, pattern: str) -> Column:
    return issue(~F.regexp_like(c, F.lit("(?dU)" + pattern)), field, "pattern_error",
                 "Value does not match pattern " + pattern, c)


def _content_warning(cond: Column, message: str, c: Column) -> Column:
    return issue(cond, "text", "content_warning", message, c, "warning")


def _with_result(df: DataFrame, errors: Column, warnings: Column) -> DataFrame:
    return (
        df.withColumn("errors", errors)
        .withColumn("warnings", warnings)
        .withColumn("is_valid", F.size("errors") == 0)
        .withColumn("quality", quality_score(F.size("errors"), F.size("warnings")))
    )


def validate_notes(notes: DataFrame, text: str = "text", note_id: str = "note_id",
                   timestamp: str = "timestamp") -> DataFrame:
    """Field rules and text-content rules of a note; a NULL field counts as missing."""
    t, i, ts = F.col(text), F.col(note_id), F.col(timestamp)
    ws = tx.WS
    errors = issue_array(
        _missing("text", t), _too_short("text", t, NOTE_TEXT_LENGTH[0]),
        _missing("note_id", i), _mismatch("note_id", i, NOTE_ID_PATTERN),
        _missing("timestamp", ts), _mismatch("timestamp", ts, NOTE_TS_PATTERN),
        issue(tx.strip_ws(t) == "", "text", "content_error",
              "Nothing but white space", t),
    )
    only_special = rf"(?d)^(?:(?!{ws})[^{tx.WORD}])*$"
    warnings = issue_array(
        _too_long("text", t, NOTE_TEXT_LENGTH[1]),
        _too_long("note_id", i, NOTE_ID_MAX),
        _content_warning(F.regexp_like(t, F.lit(rf"(?d)^{ws}*$")), "Only white space", t),
        _content_warning(F.regexp_like(t, F.lit(only_special)), "Neither letters nor digits", t),
        _content_warning(F.regexp_like(t, F.lit(r"(?d)^(.)\1{10,}")), "One character repeated", t),
        _content_warning(F.length(t) < 10, "Hardly any text", t),
    )
    return _with_result(notes, errors, warnings)


def validate_notes_batch(notes: DataFrame, order_by: str, **fields: str) -> DataFrame:
    """Results keyed by note id: a missing id becomes ``note_{position}``, the last of equal ids wins."""
    note_id = fields.get("note_id", "note_id")
    checked = validate_notes(notes, **fields).withColumn(
        "result_id", F.coalesce(F.col(note_id).cast("string"), F.concat(F.lit("note_"), F.col(order_by).cast("string")))
    )
    return keep_last(checked, ["result_id"], order_by)


def example_warnings(examples: Column) -> Column:
    """Second and later copies of an example, and examples under five characters."""
    index = F.sequence(F.lit(0), F.size(examples) - 1)
    nonempty = F.size(examples) > 0
    name = lambda i: F.concat(F.lit("examples["), i.cast("string"), F.lit("]"))
    repeated = F.transform(index, lambda i: issue(
        F.array_position(examples, F.get(examples, i)) < i + 1, name(i), "duplicate_warning",
        "Duplicate example found", F.get(examples, i), "warning"))
    short = F.transform(index, lambda i: issue(
        F.length(tx.strip_ws(F.get(examples, i))) < 5, name(i), "quality_warning",
        "Example is very short", F.get(examples, i), "warning"))
    return F.when(nonempty, F.array_compact(F.concat(repeated, short)).cast(_ISSUE_TYPE)).otherwise(
        F.array().cast(_ISSUE_TYPE))


def validate_tags(tags: DataFrame) -> DataFrame:
    """Rules of a tag definition: name, description, examples, threshold."""
    name, text = F.col("tag"), F.col("description")
    examples, threshold = F.col("examples"), F.col("confidence_threshold")
    low, high = TAG_THRESHOLD_RANGE
    few, many = TAG_EXAMPLES_COUNT
    errors = issue_array(
        _missing("tag", name), _mismatch("tag", name, TAG_NAME_PATTERN),
        _missing("description", text), _too_short("description", text, TAG_DESCRIPTION_LENGTH[0]),
        _missing("examples", examples),
        issue(F.size(examples) < few, "examples", "count_error",
              F.format_string(f"Minimum count is {few}, got %d", F.size(examples)), F.to_json(examples)),
        _missing("confidence_threshold", threshold),
        issue(threshold < low, "confidence_threshold", "value_error",
              F.concat(F.lit(f"Minimum value is {low}, got "), threshold.cast("string")), threshold),
        issue(threshold > high, "confidence_threshold", "value_error",
              F.concat(F.lit(f"Maximum value is {high}, got "), threshold.cast("string")), threshold),
    )
    warnings = issue_array(
        _too_long("tag", name, TAG_NAME_MAX),
        _too_long("description", text, TAG_DESCRIPTION_LENGTH[1]),
        issue(F.size(examples) > many, "examples", "count_warning",
              F.format_string(f"Maximum count is {many}, got %d", F.size(examples)),
              F.to_json(examples), "warning"),
    )
    return _with_result(tags, errors, F.concat(warnings, F.coalesce(example_warnings(examples),
                                                                    F.array().cast(_ISSUE_TYPE))))


def ontology_problems(tags: DataFrame) -> DataFrame:
    """One row per completeness problem of the ontology."""
    name = F.coalesce("tag", F.lit(""))
    said = lambda text: F.concat(F.lit("Tag '"), name, F.lit("' " + text))
    threshold = F.col("confidence_threshold")
    problems = F.array_compact(F.array(
        F.when(name == "", F.lit("Tag name is empty")),
        F.when(F.coalesce("description", F.lit("")) == "", said("has empty description")),
        F.when(F.coalesce(F.size("examples"), F.lit(0)) < 1, said("has no examples")),
        F.when((threshold < 0) | (threshold > 1),
               F.concat(said("has invalid confidence threshold: "), threshold.cast("string"))),
    ))
    return tags.select("tag", F.explode(problems).alias("problem"))


def validate_content(df: DataFrame, content: str = "content", required: tuple[str, ...] = ("content",),
                     check_characters: bool = False) -> DataFrame:
    """Input content rules; here a text over the maximum is an error."""
    c = F.coalesce(F.col(content), F.lit(""))
    low, high = CONTENT_LENGTH
    prohibited = "|".join(PROHIBITED_PATTERNS)
    bad = F.regexp_like(c, F.lit(f"(?i){prohibited}"))
    checks = [
        F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "",
               F.lit(f"Required field '{f}' is missing or empty")) for f in required
    ] + [
        F.when(F.length(c) < low, F.lit(f"Content too short (minimum {low} characters)"))
        .when(F.length(c) > high, F.lit(f"Content too long (maximum {high} characters)")),
        F.when(bad, F.lit("Content contains invalid characters or format")),
    ]
    if check_characters:
        checks.append(F.when(F.regexp_like(c, F.lit(ALLOWED_CONTENT)), F.lit("Content has characters not allowed")))
    out = df.withColumn("content_errors", F.array_compact(F.array(*checks)))
    return out.withColumn("content_valid", F.size("content_errors") == 0)


def valid_uuid(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(UUID_PATTERN)), F.lit(False))


def one_of(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def in_range(c: Column, low: float, high: float) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def detect_outliers(notes: DataFrame, field: str = "text", note_id: str = "note_id") -> DataFrame:
    """Rows whose length (strings) or value (numbers) lies over two deviations from the mean."""
    is_text = notes.schema[field].dataType.simpleString() == "string"
    sized = notes.withColumn("field_value", (F.length(field) if is_text else F.col(field)).cast("double"))
    stats = sized.agg(F.struct(F.avg("field_value").alias("mean"),
                               F.stddev_pop("field_value").alias("std")).alias("s"))
    return (
        sized.withColumn("_s", stats.scalar())
        .withColumn("deviation", F.abs(F.col("field_value") - F.col("_s.mean")))
        .withColumn("threshold", 2 * F.col("_s.std"))
        .filter(F.col("deviation") > F.col("threshold"))
        .select(F.col(note_id), F.lit(field).alias("field"), F.col(field).alias("value"),
                "field_value", "deviation", "threshold")
    )


def issue_rows(checked: DataFrame, item_id: str) -> DataFrame:
    """All errors and warnings of all items, one row each."""
    return checked.select(F.col(item_id).alias("item_id"),
                          F.inline(F.concat("errors", "warnings")))


def validation_summary(checked: DataFrame) -> DataFrame:
    """Totals, rate and mean quality in one aggregate."""
    return checked.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if("is_valid").alias("valid_items"),
        F.count_if(~F.col("is_valid")).alias("invalid_items"),
        F.coalesce(F.avg(F.col("is_valid").cast("double")), F.lit(0.0)).alias("validation_rate"),
        F.bround(F.coalesce(F.avg("quality"), F.lit(0.0)), 3).alias("average_quality_score"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("total_errors"),
        F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("total_warnings"),
    )


def error_type_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("errors.error_type").alias("error_type")).groupBy("error_type").agg(
        F.count(F.lit(1)).alias("count"))


def input_summary(checked: DataFrame, outliers: DataFrame | None, kind: str) -> DataFrame:
    """Total, valid, invalid, mean quality and outlier count of one kind of input."""
    base = checked.agg(
        F.lit(kind).alias("kind"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.coalesce(F.avg("quality"), F.lit(0.0)).alias("avg_quality_score"),
    )
    if outliers is None:
        return base.withColumn("outliers", F.lit(0).cast("long"))
    return base.withColumn("outliers", outliers.agg(F.count(F.lit(1))).scalar())
