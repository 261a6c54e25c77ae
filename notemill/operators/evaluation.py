"""Evaluation of routed notes: all measures derive from one (true, predicted) count table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notemill.operators.ordering import hashed_row_number
from notemill.runtime import broadcast_if_small, cut_lineage

# Sizes of known models in MB, and the default.
MODEL_SIZE_MB = {
    "all-MiniLM-L6-v2": 90.0,
    "all-mpnet-base-v2": 420.0,
    "all-MiniLM-L12-v2": 120.0,
    "paraphrase-multilingual-MiniLM-L12-v2": 140.0,
    "multi-qa-MiniLM-L6-cos-v1": 90.0,
}
DEFAULT_MODEL_SIZE_MB = 200.0


def keep_known_tags(results: DataFrame, tags: DataFrame, true: str = "true_tag",
                    predicted: str = "routed_tag") -> DataFrame:
    """Rows whose true and predicted tag are both in the ontology."""
    names = broadcast_if_small(tags.select("tag").distinct())
    return (
        results.join(names.withColumnRenamed("tag", true), true, "left_semi")
        .join(names.withColumnRenamed("tag", predicted), predicted, "left_semi")
    )


def unknown_tags(results: DataFrame, tags: DataFrame, column: str = "routed_tag") -> DataFrame:
    """Labels outside the ontology, with their row counts."""
    names = broadcast_if_small(tags.select(F.col("tag").alias(column)).distinct())
    return results.join(names, column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(results: DataFrame, true: str = "true_tag", predicted: str = "routed_tag",
                     by: list[str] | None = None) -> DataFrame:
    """Rows per (true, predicted), pre-aggregated map-side; at most tags x tags rows."""
    return results.groupBy(*(by or []), F.col(true).alias("true_tag"), F.col(predicted).alias("pred_tag")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, tags: DataFrame) -> DataFrame:
    """Dense (true, predicted, n) grid with zeros, over the ontology's tags.

    The grid is the outer product of the ontology with itself, built by
    exploding the tag list inside each tag's row.
    """
    names = tags.select("tag").distinct()
    every = names.agg(F.array_sort(F.collect_list("tag")))  # one row per ontology tag
    grid = names.select(F.col("tag").alias("true_tag"), F.explode(every.scalar()).alias("pred_tag"))
    return grid.join(counts, ["true_tag", "pred_tag"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_tag_metrics(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One-vs-rest precision, recall, F1 and support per tag, 0 where undefined."""
    by = by or []
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("true_tag").alias("tag"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("true_tag") == F.col("pred_tag"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred_tag").alias("tag"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("tp")),
    )).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "tag").agg(
        F.sum("tp").alias("tp"), F.sum("called").alias("called"), F.sum("support").alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        sums.withColumn("precision", ratio(F.col("tp"), F.col("called")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1_score", ratio(2 * F.col("tp"), F.col("called") + F.col("support")))
        .select(*by, "tag", "precision", "recall", "f1_score", "support")
    )


def with_all_tags(per_tag: DataFrame, tags: DataFrame) -> DataFrame:
    """Add ontology tags that occur in no row, with zero metrics."""
    zeros = {"precision": 0.0, "recall": 0.0, "f1_score": 0.0, "support": 0}
    return tags.select("tag").join(per_tag, "tag", "left").fillna(zeros)


def weighted_metrics(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Support-weighted precision, recall and F1, with accuracy.

    Without one row of known tags there is nothing to weigh: the query fails when it runs, as a report
    of NULL scores would be read as one. Groups (``by``) without known rows have no row.
    """
    by = by or []
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    scores = per_tag_metrics(counts, by).groupBy(*by).agg(
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1_score").alias("f1_score"),
        F.sum("support").alias("n"),
    )
    known = F.when(F.col("n").isNull(), F.raise_error(F.lit("no row has known tags")).cast("bigint")).otherwise(F.col("n"))
    # support-weighted recall is the share of correct rows
    return scores.withColumn("n", known).withColumn("accuracy", F.col("recall"))


def outcome_table(results: DataFrame, confidence: str = "confidence", time_ms: str | None = None,
                  by: list[str] | None = None, extra: list[Column] | None = None) -> DataFrame:
    """Everything the scores need, in one pass: per (group, true, predicted) counts and sums.

    Correctness is constant within a pair of tags, so these sums also give the
    correlation. The table has at most tags x tags rows per group; it is
    written once, so routing is not repeated for each measure.
    """
    c, t = F.col(confidence), F.col(time_ms) if time_ms else F.lit(0.0)
    return cut_lineage(results.groupBy(
        *(by or []), F.col("true_tag"), F.col("routed_tag").alias("pred_tag")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c).alias("c"), F.sum(c * c).alias("cc"), F.sum(t).alias("t"),
        F.count(t).alias("timed"), *(extra or [])))


def known_outcomes(outcomes: DataFrame, tags: DataFrame) -> DataFrame:
    """Outcome rows whose tags are both in the ontology."""
    return keep_known_tags(outcomes, tags, predicted="pred_tag")


def correlation_from_sums(n: Column, c: Column, cc: Column, y: Column, cy: Column) -> Column:
    """Pearson correlation of a score with a 0/1 outcome from their sums; 0 where undefined."""
    spread = (n * cc - c * c) * (n * y - y * y)
    return F.when(spread > 0, (n * cy - c * y) / F.sqrt(spread)).otherwise(F.lit(0.0))


def metrics_from_outcomes(outcomes: DataFrame, tags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group: weighted scores, accuracy, confidence correlation, mean time.

    Time is averaged over all rows, the scores over rows with known tags only.
    """
    by = by or []
    known = known_outcomes(outcomes, tags)
    scores = weighted_metrics(known.select(*by, "true_tag", "pred_tag", "n"), by)
    right = F.col("true_tag") == F.col("pred_tag")
    sums = known.groupBy(*by).agg(
        F.sum("n").cast("double").alias("n"), F.sum("c").alias("c"), F.sum("cc").alias("cc"),
        F.sum(F.when(right, F.col("n")).otherwise(0)).cast("double").alias("y"),
        F.sum(F.when(right, F.col("c")).otherwise(0.0)).alias("cy"))
    corr = sums.select(*by, correlation_from_sums(
        *[F.col(x) for x in ("n", "c", "cc", "y", "cy")]).alias("confidence_correlation"))
    times = outcomes.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum("t"), F.sum("timed")), F.lit(0.0)).alias("processing_time_ms"))
    if by:
        return scores.join(corr, by).join(times, by)
    # three one-row aggregates of the small table side by side
    row = lambda df: F.struct(*df.columns)
    return (
        scores.withColumn("_c", corr.select(row(corr)).scalar())
        .withColumn("_t", times.select(row(times)).scalar())
        .select("*", "_c.confidence_correlation", "_t.processing_time_ms").drop("_c", "_t")
    )


def evaluate(results: DataFrame, tags: DataFrame, confidence: str = "confidence",
             time_ms: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Scores of routed, labelled results; reads them once."""
    return metrics_from_outcomes(outcome_table(results, confidence, time_ms, by), tags, by)


def worst_tags(per_tag: DataFrame, n: int = 3) -> DataFrame:
    return per_tag.orderBy("f1_score", "tag").limit(n)


# --- splits ----------------------------------------------------------------

def _digest(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def stratified_folds(df: DataFrame, label: str, id_col: str, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: rows of a label, in hash order, dealt out in turn."""
    keyed = df.withColumn("_digest", _digest(id_col, seed))
    numbered = hashed_row_number(keyed, label, "_digest", id_col, "_rn")
    return numbered.withColumn("fold", ((F.col("_rn") - 1) % n_splits).cast("int")).drop("_digest", "_rn")


def stratified_split(df: DataFrame, label: str, id_col: str, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: the first rows of a label in hash order, up to its training share."""
    keyed = df.withColumn("_digest", _digest(id_col, seed))
    numbered = hashed_row_number(keyed, label, "_digest", id_col, "_rn", total="_n")
    train = F.col("_rn") <= F.col("_n") - F.ceil(F.col("_n") * validation)
    return numbered.withColumn("is_train", train).drop("_digest", "_rn", "_n")


def cross_validate(notes: DataFrame, tags: DataFrame, router: Callable[[DataFrame], DataFrame],
                   label: str = "true_tag", id_col: str = "note_id", n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Metrics per fold for a router that needs no training: it runs once over all folds."""
    routed = router(stratified_folds(notes, label, id_col, n_splits, seed))
    return evaluate(routed, tags, by=["fold"])


def cross_validate_trained(notes: DataFrame, tags: DataFrame,
                           router: Callable[[DataFrame, DataFrame], DataFrame], label: str = "true_tag",
                           id_col: str = "note_id", n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Metrics per fold for ``router(train, test)``, which returns ``test`` with routed_tag and confidence.

    The fold assignment is written once; each of the few folds is one branch of the plan.
    """
    folded = cut_lineage(stratified_folds(notes, label, id_col, n_splits, seed))
    routed = None
    for fold in range(n_splits):
        part = router(folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold))
        routed = part if routed is None else routed.unionByName(part)
    return evaluate(routed, tags, by=["fold"])


def cross_validate_centroids(notes: DataFrame, tags: DataFrame, label: str = "true_tag", id_col: str = "note_id",
                             n_splits: int = 5, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """Metrics per fold of routing to mean vectors that were computed without the fold.

    The notes are read twice, for the sums by (tag, fold) and for routing, whatever the number of folds.
    """
    from notemill.operators.embedding import leave_one_out_means
    from notemill.operators.routing import route_by_fold

    folded = cut_lineage(stratified_folds(notes.select(id_col, label, "vector"), label, id_col, n_splits, seed))
    known = folded.filter(F.col(label).isNotNull())
    means = leave_one_out_means(known, label, "fold", n_splits).withColumnRenamed(label, "tag")
    routed = route_by_fold(folded, means, threshold=threshold).drop("vector")
    return evaluate(routed.withColumnRenamed(label, "true_tag"), tags, by=["fold"])


# --- model comparison ------------------------------------------------------

def memory_estimate_mb(dimension: Column) -> Column:
    return F.least(dimension.cast("double") * 4 * 1000 / F.lit(1024.0 * 1024.0), F.lit(1000.0))


def model_size_mb(model: Column) -> Column:
    entries = [F.lit(x) for pair in MODEL_SIZE_MB.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), model), F.lit(DEFAULT_MODEL_SIZE_MB))


def union_models(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several models under a ``model_name`` column."""
    union = None
    for name, df in results.items():
        tagged = df.withColumn("model_name", F.lit(name))
        union = tagged if union is None else union.unionByName(tagged)
    return union


def compare_models(results: DataFrame, tags: DataFrame, time_ms: str | None = None) -> DataFrame:
    """One row per model: scores, time, memory, dimension and size. Needs ``embedding_dimension``."""
    by = ["model_name"]
    outcomes = outcome_table(results, time_ms=time_ms, by=by,
                             extra=[F.max("embedding_dimension").alias("embedding_dimension")])
    dims = outcomes.groupBy("model_name").agg(F.max("embedding_dimension").alias("embedding_dimension"))
    return (
        metrics_from_outcomes(outcomes, tags, by).join(dims, "model_name")
        .withColumn("memory_usage_mb", memory_estimate_mb(F.col("embedding_dimension")))
        .withColumn("model_size_mb", model_size_mb(F.col("model_name")))
    )


def rank_models(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(F.desc("f1_score"), "model_name")


def best_model(comparison: DataFrame, criteria: str = "f1_score") -> DataFrame:
    """One row; ties go to the first name."""
    if criteria in ("f1_score", "precision", "recall"):
        order = F.desc(criteria)
    elif criteria == "speed":
        order = F.asc("processing_time_ms")
    else:
        raise ValueError(f"Unknown criteria: {criteria}")
    return comparison.orderBy(order, "model_name").limit(1)


def model_tradeoff(comparison: DataFrame) -> DataFrame:
    """The best model next to the runner-up, and whether the runner-up is the better bargain.

    The window runs over one row per model.
    """
    by_score = W.orderBy(F.desc("f1_score"), "model_name")
    second = F.lead(F.struct("model_name", "f1_score", "processing_time_ms")).over(by_score)
    top = comparison.withColumn("_second", second).withColumn("_rank", F.row_number().over(by_score))
    bargain = (F.col("f1_score") - F.col("_second.f1_score") < 0.05) & (
        F.col("_second.processing_time_ms") < F.col("processing_time_ms") * 0.7)
    return top.filter("_rank = 1").select(
        "model_name", "f1_score", F.col("_second.model_name").alias("second_model"),
        F.col("_second.f1_score").alias("second_f1"),
        F.coalesce(bargain, F.lit(False)).alias("prefer_second"),
    )
