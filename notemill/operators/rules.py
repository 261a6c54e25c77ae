"""Rule-based routing: keyword categories, condition rules, when-tables, weighted choice."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import text as tx

# Example keyword rules (category, threshold, keywords).
KEYWORD_RULES = {
    "technical": (0.6, ["api", "documentation", "code", "function", "class"]),
    "project": (0.7, ["project", "timeline", "milestone", "deadline", "sprint"]),
    "personal": (0.8, ["thought", "feeling", "experience", "reflection", "personal"]),
}
# Words that map to a category.
CATEGORY_MAPPING = {
    "research": ["study", "analysis", "investigation"],
    "personal": ["diary", "reflection", "thoughts"],
    "work": ["project", "task", "meeting"],
    "learning": ["tutorial", "course", "education"],
}
# Category to storage.
STORAGE_BY_CATEGORY = {
    "research": "research_storage",
    "personal": "personal_storage",
    "work": "work_storage",
    "learning": "learning_storage",
}


# --- when-tables -----------------------------------------------------------

def route_by_category(category: Column) -> Column:
    entries = [F.lit(x) for pair in STORAGE_BY_CATEGORY.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), category), F.lit("general_storage"))


# Destination from each bound on, least first. Sizes are in characters above the
# bound, deadlines in hours ahead, times of day in hours.
SIZE_BANDS = [(None, "fast_processor"), (1_000, "standard_processor"), (10_000, "batch_processor")]
DEADLINE_BANDS = [(None, "urgent_processor"), (1, "priority_processor"), (24, "standard_processor")]
HOUR_BANDS = [(None, "background_processor"), (9, "business_processor"), (18, "background_processor")]
LENGTH_BANDS = [(None, "short"), (100, "medium"), (500, "long")]
# Priority to queue, and the queue of any other priority.
PRIORITY_QUEUES = {"high": "priority_queue", "low": "background_processor"}
OTHER_QUEUE = "standard_queue"


def in_band(value: Column, bands: list[tuple[float | None, str]], above: bool = False) -> Column:
    """Name of the last band whose bound the value reaches (with ``above``: exceeds); NULL goes to the band that
    a comparison with NULL leaves: the first one when counted up."""
    reached = [F.when(value > bound if above else value >= bound, F.lit(name)) for bound, name in reversed(bands[1:])]
    return F.coalesce(*reached, F.lit(bands[0][1]))


def route_by_size(length: Column) -> Column:
    return in_band(length, SIZE_BANDS, above=True)


def route_by_priority(priority: Column) -> Column:
    queues = F.create_map(*[F.lit(x) for pair in PRIORITY_QUEUES.items() for x in pair])
    return F.coalesce(F.try_element_at(queues, priority), F.lit(OTHER_QUEUE))


def route_by_deadline(deadline: Column, now: Column) -> Column:
    """By the hours that are left; a note without a deadline has time."""
    hours = (F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(3.6e9)
    return F.when(deadline.isNull(), F.lit(DEADLINE_BANDS[-1][1])).otherwise(in_band(hours, DEADLINE_BANDS))


def route_by_time_of_day(ts: Column) -> Column:
    return in_band(F.hour(ts), HOUR_BANDS)


def length_bucket(text: Column) -> Column:
    """Batching class of a text; a NULL text counts as long."""
    return F.when(text.isNull(), F.lit(LENGTH_BANDS[-1][1])).otherwise(in_band(F.length(text), LENGTH_BANDS))


def batch_by_length(df: DataFrame, text: str = "text") -> DataFrame:
    """Order rows inside each partition by length class, so a model's batches need little padding."""
    return df.withColumn("length_bucket", length_bucket(F.col(text))).sortWithinPartitions(F.length(text))


def accept_prediction(category: Column, score: Column, minimum: float = 0.7, default: str = "general") -> Column:
    return F.when(score >= minimum, category).otherwise(F.lit(default))


def keep_categories(categories: Column, limit: int = 3) -> Column:
    return F.slice(categories, 1, limit)


def fallback_destination(*candidates: Column, valid: list[str], default: str) -> Column:
    """First destination of the chain that is valid."""
    return F.coalesce(*[F.when(c.isin(*valid), c) for c in candidates], F.lit(default))


# --- keyword rules ---------------------------------------------------------

def keyword_scores(tokens: Column, rules: dict[str, tuple[float, list[str]]] = KEYWORD_RULES) -> Column:
    """Array of (category, score, threshold): share of a category's keywords among the tokens."""
    return F.array(*[
        F.struct(
            F.lit(category).alias("category"),
            (F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))) / F.lit(float(len(words)))).alias("score"),
            F.lit(threshold).alias("threshold"),
        )
        for category, (threshold, words) in rules.items()
    ])


def classify_by_keywords(notes: DataFrame, text: str = "text",
                         rules: dict[str, tuple[float, list[str]]] = KEYWORD_RULES,
                         default: str = "general") -> DataFrame:
    """Best category whose score reaches its threshold, else the default; at most three are kept."""
    passed = F.filter("_scores", lambda s: s["score"] >= s["threshold"])
    ranked = F.array_sort(F.transform(passed, lambda s: F.struct(
        (-s["score"]).alias("neg"), s["category"].alias("category"))))
    return (
        notes.withColumn("_tokens", tx.words(tx.normalize_text(F.col(text))))
        .withColumn("_scores", keyword_scores(F.col("_tokens"), rules))
        .withColumn("categories", keep_categories(F.transform(ranked, lambda s: s["category"])))
        .withColumn("category", F.coalesce(F.get("categories", F.lit(0)), F.lit(default)))
        .drop("_tokens", "_scores")
    )


def keyword_tags(text: Column, keywords: list[str]) -> Column:
    """Keywords that occur anywhere in the text (plain substrings), in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords]))


def append_tags(existing: Column, found: Column) -> Column:
    """Existing tags followed by the found ones; repeats stay."""
    return F.concat(existing, found)


def map_categories(notes: DataFrame, text: str = "text", mapping: dict[str, list[str]] = CATEGORY_MAPPING,
                   out: str = "categories") -> DataFrame:
    """Categories with at least one of their words in the text."""
    found = F.array_compact(F.array(*[
        F.when(F.arrays_overlap("_tokens", F.array(*[F.lit(w) for w in words])), F.lit(category))
        for category, words in mapping.items()
    ]))
    tokens = tx.words(tx.normalize_text(F.col(text)))
    return notes.withColumn("_tokens", tokens).withColumn(out, found).drop("_tokens")


# --- condition rules -------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object
    logical_operator: str = "AND"  # joins this condition to those before it


@dataclass(frozen=True)
class Rule:
    rule_id: str
    conditions: list[Condition]
    destination: str
    priority: int
    enabled: bool = True
    actions: dict[str, str] = field(default_factory=dict)


_OPERATORS = {
    "equals": operator.eq,
    "not_equals": operator.ne,
    "greater_than": operator.gt,
    "less_than": operator.lt,
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "regex": lambda c, v: F.regexp_like(c, F.lit(v)),
}


def rule_predicate(rule: Rule) -> Column:
    """The rule's conditions as one boolean column; an unknown value counts as not met."""
    def one(cond: Condition) -> Column:
        return F.coalesce(_OPERATORS[cond.operator](F.col(cond.field), cond.value), F.lit(False))

    first, *rest = rule.conditions
    return reduce(lambda acc, c: acc | one(c) if c.logical_operator == "OR" else acc & one(c), rest, one(first))


def apply_rules(df: DataFrame, rules: list[Rule], default: str = "default") -> DataFrame:
    """Destination of the highest-priority enabled rule that matches (ties: rule id).

    Rules are compiled into one array of hits, so each row is read once and no join is made.
    """
    active = sorted((r for r in rules if r.enabled), key=lambda r: (-r.priority, r.rule_id))
    if not active:
        return df.withColumns({"rule_id": F.lit(None).cast("string"), "destination": F.lit(default),
                               "matched_rules": F.array().cast("array<string>")})
    # every rule is tried once a row; the first hit decides
    hits = F.array_compact(F.array(*[
        F.when(rule_predicate(r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.destination).alias("destination")))
        for r in active]))
    name = "_hits"
    while name in df.columns:
        name = "_" + name
    first = F.get(F.col(name), F.lit(0))
    return df.withColumn(name, hits).withColumns({
        "rule_id": first["rule_id"], "destination": F.coalesce(first["destination"], F.lit(default)),
        "matched_rules": F.transform(name, lambda h: h["rule_id"])}).drop(name)


# --- weighted and round-robin choice ---------------------------------------

def unit_hash(key: Column) -> Column:
    """Uniform number in [0, 1) from the first 28 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("double") / F.lit(float(16 ** 7))


def weighted_destination(key: Column, weights: list[tuple[str, float]]) -> Column:
    """Destination whose cumulative-weight interval holds the key's hash."""
    total = sum(w for _, w in weights)
    draw, upper, chosen = unit_hash(key) * F.lit(float(total)), 0.0, None
    for name, weight in weights:
        upper += weight
        inside = draw < F.lit(float(upper))
        chosen = F.when(inside, name) if chosen is None else chosen.when(inside, name)
    return F.coalesce(chosen, F.lit(weights[0][0]))


# --- model choice ----------------------------------------------------------

def select_model(models: DataFrame, language: str | None = None, min_dimension: int | None = None,
                 max_time_ms: float | None = None, max_memory_mb: float | None = None) -> DataFrame:
    """Best model (by F1, then name) of a model table that meets every given requirement."""
    if language is not None:
        models = models.filter(F.array_contains("languages", language))
    for column, bound, keep in (
        ("embedding_dimension", min_dimension, operator.ge),
        ("processing_time_ms", max_time_ms, operator.le),
        ("memory_usage_mb", max_memory_mb, operator.le),
    ):
        if bound is not None:
            models = models.filter(keep(F.col(column), F.lit(bound)))
    return models.orderBy(F.desc("f1_score"), "model_name").limit(1)
