"""Note-level operators: de-duplication, length filter, parsing of capture lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notemill.functions import text as tx
from notemill.functions.scoring import quality_score
from notemill.functions.vectors import let

# Limits of the capture grammar.
MAX_TAGS = 10
MAX_BODY = 1000
MAX_COMMENT = 200
ALLOWED_TAG = r"^[a-zA-Z_][a-zA-Z0-9_]*$"

TS_FORMAT_OK = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"
)


def key_digest(keys: list[str]) -> Column:
    """32 bytes that stand for the values of ``keys``; NULL for a single NULL key."""
    joined = F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(joined, 256))


def _keep_extreme(df: DataFrame, keys: list[str], order_by: str, pick) -> DataFrame:
    """One row per key: digests and order values are aggregated, then rows are picked by both.

    No text is a grouping key or in an aggregate, so that copies shrink to 40 bytes before the
    shuffle. Rows meet the winners by (digest, order value), so that a text that makes up a third of
    the input is spread by its order values. Of rows equal in key and order value one stays.
    """
    # a fresh name, as the input may have any
    digest, order = "__digest", "__order"
    keyed = df.withColumn(digest, key_digest(keys)).withColumn(order, F.col(order_by))
    winners = keyed.groupBy(digest).agg(pick(order).alias(order))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (digest, order)]
    met = keyed.alias("r").join(winners.alias("w"), on, "left_semi")
    same = W.partitionBy(digest, order).orderBy(order)
    return met.withColumn("__n", F.row_number().over(same)).filter("__n = 1").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """One row per key, the one with the smallest ``order_by``."""
    return _keep_extreme(df, keys, order_by, F.min)


def keep_last(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """One row per key, the one with the largest ``order_by``."""
    return _keep_extreme(df, keys, order_by, F.max)


def deduplicate_notes(notes: DataFrame, order_by: str = "note_id", text: str = "text") -> DataFrame:
    return keep_first(notes, [text], order_by)


def filter_by_length(notes: DataFrame, min_words: int = 3, max_words: int = 500, text: str = "text") -> DataFrame:
    """Rows with ``min_words`` to ``max_words`` words, both included.

    Written as one comparison, since the two of a ``between`` would each count
    the words (and repeat whatever made the text column).
    """
    twice = tx.word_count(F.col(text)) * 2
    return notes.filter(F.abs(twice - (min_words + max_words)) <= max_words - min_words)


def is_iso_timestamp(c: Column) -> Column:
    """Shape and calendar both valid."""
    return F.regexp_like(c, F.lit(TS_FORMAT_OK)) & F.try_to_timestamp(c).isNotNull()


def _grammar_errors(tags: Column, body: Column, timestamp: Column) -> Column:
    bad_tags = F.transform(
        F.filter(tags, lambda t: ~F.regexp_like(t, F.lit(ALLOWED_TAG))),
        lambda t: F.concat(F.lit("Invalid tag format: "), t),
    )
    too_many = F.when(F.size(tags) > MAX_TAGS,
                      F.format_string(f"Too many tags: %d > {MAX_TAGS}", F.size(tags)))
    no_body = F.when(body == "", F.lit("Body is required but empty"))
    bad_ts = F.when(timestamp.isNotNull() & ~is_iso_timestamp(timestamp),
                    F.concat(F.lit("Invalid timestamp format: "), timestamp))
    return F.array_compact(F.concat(F.array(too_many), bad_tags, F.array(no_body, bad_ts)))


def _grammar_warnings(body: Column, comment: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.length(body) > MAX_BODY,
               F.format_string(f"Body too long: %d > {MAX_BODY}", F.length(body))),
        F.when(F.length(comment) > MAX_COMMENT,
               F.format_string(f"Comment too long: %d > {MAX_COMMENT}", F.length(comment))),
    ))


def parse_capture(lines: DataFrame, raw: str = "raw_text", auto_timestamp: bool = True,
                  run_ts: str | None = None) -> DataFrame:
    """Parse ``#tag body //comment @timestamp`` lines in one narrow pass.

    Bad lines stay as rows with ``valid = false`` and their issues. ``run_ts``
    is the time given to lines without one; the query start time by default.
    """
    now = F.lit(run_ts) if run_ts else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.col(raw)
    parsed = (
        lines.withColumn("tags", tx.extract_tags(text))
        .withColumn("comment", tx.extract_comment(text))
        .withColumn("_found_ts", tx.extract_timestamp(text))
        .withColumn("body", tx.extract_body(text, F.col("tags"), F.col("comment"), F.col("_found_ts")))
        .withColumn("timestamp", F.coalesce("_found_ts", now))
    )
    stamped = F.lit(auto_timestamp) & F.col("_found_ts").isNull()
    return (
        parsed.withColumn("issues", _grammar_errors(F.col("tags"), F.col("body"), F.col("_found_ts")))
        .withColumn("warnings", _grammar_warnings(F.col("body"), F.col("comment")))
        .withColumn("valid", F.size("issues") == 0)
        .withColumn("quality", quality_score(F.size("issues"), F.size("warnings")))
        .withColumn("metadata", F.when(stamped, F.create_map(F.lit("auto_timestamped"), F.lit("true")))
                    .otherwise(F.create_map().cast("map<string,string>")))
        .drop("_found_ts")
    )


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.filter("valid"), parsed.filter(~F.col("valid"))


def fan_out(parsed: DataFrame) -> DataFrame:
    """One copy of the note per tag; notes without tags go to ``untagged``."""
    tags = F.when(F.size("tags") == 0, F.array(F.lit("untagged"))).otherwise(F.col("tags"))
    extra = [c for c in ("note_id",) if c in parsed.columns]
    return parsed.select(
        *extra, F.explode(tags).alias("tag"), "body", "comment", "timestamp", "valid", "issues",
        "metadata", F.col("tags").alias("all_tags"),
    )


def capture_stats(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count(F.lit(1)).alias("total_notes"),
        F.count_if("valid").alias("valid_notes"),
        F.count_if(~F.col("valid")).alias("invalid_notes"),
        F.count_if(F.size("tags") > 0).alias("notes_with_tags"),
        F.count_if(F.col("comment").isNotNull() & (F.col("comment") != "")).alias("notes_with_comments"),
        F.coalesce(F.avg(F.size("tags")), F.lit(0.0)).alias("avg_tags_per_note"),
    )


def tag_correlation(routed: DataFrame, tags: str = "tags", routed_tag: str = "routed_tag") -> DataFrame:
    """Per user tag: notes carrying it, how many were routed to it, and the rate."""
    pairs = routed.select(F.explode(F.array_distinct(tags)).alias("tag"), F.col(routed_tag).alias("_routed"))
    return pairs.groupBy("tag").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("tag") == F.col("_routed")).alias("route_matches"),
    ).withColumn("correlation_rate", F.col("route_matches") / F.col("count"))


def language_scores(text: Column, stop_words: dict[str, list[str]]) -> Column:
    """Array of (hits, lang): stop-word occurrences per language, counted inside the row."""
    tokens = F.split(F.lower(text), rf"[^{tx.WORD}]+")
    every = sorted({w for words in stop_words.values() for w in words})
    # most tokens are no stop word, so one pass keeps the few that are
    return let(F.filter(tokens, lambda t: t.isin(every)), lambda hits: F.array(*[
        F.struct(_count_of(hits, stop_words[lang]).alias("hits"), F.lit(lang).alias("lang"))
        for lang in sorted(stop_words)
    ]))


def _count_of(tokens: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(wanted)))


def detect_language(notes: DataFrame, stop_words: dict[str, list[str]], text: str = "text",
                    fallback: str = "en", min_confidence: float = 0.8) -> DataFrame:
    """Language with the largest share of stop-word hits; the fallback below the confidence."""
    scored = notes.withColumn("_hits", language_scores(F.col(text), stop_words))
    total = F.aggregate("_hits", F.lit(0), lambda acc, x: acc + x["hits"])
    # most hits first, then language name
    best = F.element_at(F.array_sort(F.transform("_hits", lambda x: F.struct(
        (-x["hits"]).alias("neg"), x["lang"].alias("lang")))), 1)
    share = F.coalesce(F.try_divide(-best["neg"], total), F.lit(0.0))
    return (
        scored.withColumn("language_confidence", share)
        .withColumn("language", F.when(share >= min_confidence, best["lang"]).otherwise(F.lit(fallback)))
        .drop("_hits")
    )
