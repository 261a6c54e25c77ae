"""Registered queries that evaluate, compare and calibrate routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from notemill.operators import calibration as cal
from notemill.operators import evaluation as ev
from notemill.operators import observability as ob
from notemill.operators import recommendations as rec
from notemill.operators import routing as rt
from notemill.operators import rules as ru
from notemill.plans import flows as fl
from notemill.plans import inputs as inp
from notemill.runtime import cut_lineage, scratch_path
from notemill.sources import writers as wr

QUERIES = {}
ORACLE = {}

# labels 8 and 9 are left out of the ontology, so rows with them are unknown
KNOWN = [str(i) for i in range(8)]
A, B = 6.0, -1.5


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def _routed(spark, sf):
    notes = inp.labelled_vectors(spark, sf)
    return rt.route(notes, rt.build_index(inp.centroid_tags(notes))).drop("vector").withColumn(
        "time_ms", (F.col("note_id") % 7).cast("double"))


def _known_tags(spark):
    return spark.createDataFrame([(t,) for t in KNOWN], "tag string")


def _counts(spark, sf):
    return ev.known_outcomes(ev.confusion_counts(_routed(spark, sf)), _known_tags(spark))


def _round(df, *columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_KNOWN_LIST = ", ".join(f"'{t}'" for t in KNOWN)


def sql_per_tag(source: str, by: str = "") -> str:
    """CTEs cm, pt, wm over ``source`` (true_tag, routed_tag), optionally per group ``by``."""
    g = f"{by}, " if by else ""
    on = f"AND a.{by} = b.{by} " if by else ""
    return f"""
cm AS (SELECT {g}true_tag, routed_tag, count(*) AS n FROM {source} GROUP BY ALL),
lab AS (SELECT DISTINCT {g}true_tag AS tag FROM cm UNION SELECT DISTINCT {g}routed_tag FROM cm),
pt AS (
  SELECT {'a.' + by + ',' if by else ''} a.tag, coalesce(sum(n) FILTER (true_tag = tag AND routed_tag = tag), 0) AS tp,
    coalesce(sum(n) FILTER (routed_tag = tag), 0) AS called, coalesce(sum(n) FILTER (true_tag = tag), 0) AS support
  FROM lab a JOIN cm b ON (b.true_tag = a.tag OR b.routed_tag = a.tag) {on} GROUP BY ALL),
m AS (SELECT {g}tag, CASE WHEN called = 0 THEN 0 ELSE tp / called::DOUBLE END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall, 2 * tp / (called + support)::DOUBLE AS f1_score, support FROM pt),
wm AS (SELECT {g}sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
  sum(f1_score * support) / sum(support) AS f1_score, sum(support)::BIGINT AS n FROM m GROUP BY ALL)"""


_KNOWN_ROUTED = f"""WITH {inp.SQL_ROUTED},
known AS (SELECT * FROM routed WHERE true_tag IN ({_KNOWN_LIST}) AND routed_tag IN ({_KNOWN_LIST})),
{sql_per_tag('known').strip()}"""


@_query("weighted_prf", f"""{_KNOWN_ROUTED}
SELECT round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, n, round(recall, 4) AS accuracy FROM wm""")
def weighted_prf(spark, sf):
    return _round(ev.weighted_metrics(_counts(spark, sf)), "precision", "recall", "f1_score", "accuracy")


@_query("evaluate_routing", f"""{_KNOWN_ROUTED}
SELECT round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, n, round(recall, 4) AS accuracy,
  (SELECT round(coalesce(corr(conf, (true_tag = routed_tag)::INT::DOUBLE), 0), 4) FROM known) AS confidence_correlation,
  (SELECT round(avg(note_id % 7), 4) FROM routed) AS processing_time_ms FROM wm""")
def evaluate_routing(spark, sf):
    out = ev.evaluate(_routed(spark, sf), _known_tags(spark), time_ms="time_ms")
    return _round(out, "precision", "recall", "f1_score", "accuracy", "confidence_correlation", "processing_time_ms")


@_query("per_tag_metrics", f"""{_KNOWN_ROUTED}
SELECT tag, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, support::BIGINT AS support FROM m""")
def per_tag_metrics(spark, sf):
    return _round(ev.per_tag_metrics(_counts(spark, sf)), "precision", "recall", "f1_score")


@_query("worst_tags", f"""{_KNOWN_ROUTED}
SELECT tag, round(f1_score, 4) AS f1_score FROM m ORDER BY m.f1_score, tag LIMIT 3""")
def worst_tags(spark, sf):
    return _round(ev.worst_tags(ev.per_tag_metrics(_counts(spark, sf))).select("tag", "f1_score"), "f1_score")


@_query("confusion_matrix", f"""{_KNOWN_ROUTED},
t AS (SELECT unnest([{_KNOWN_LIST}]) AS tag)
SELECT a.tag AS true_tag, b.tag AS pred_tag, coalesce(n, 0) AS n FROM t a CROSS JOIN t b
LEFT JOIN cm ON cm.true_tag = a.tag AND cm.routed_tag = b.tag""")
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(_counts(spark, sf), _known_tags(spark))


@_query("unknown_tags", f"""WITH {inp.SQL_ROUTED}
SELECT routed_tag, count(*) AS n FROM routed WHERE routed_tag NOT IN ({_KNOWN_LIST}) GROUP BY 1""")
def unknown_tags(spark, sf):
    return ev.unknown_tags(_routed(spark, sf), _known_tags(spark))


@_query("evaluation_recommendations", f"""{_KNOWN_ROUTED},
w AS (SELECT tag, f1_score FROM m ORDER BY f1_score, tag LIMIT 3)
SELECT 'precision' AS code, NULL AS about, round(precision, 4) AS value FROM wm WHERE precision < 0.8
UNION ALL SELECT 'recall', NULL, round(recall, 4) FROM wm WHERE recall < 0.7
UNION ALL SELECT 'confidence', NULL, round(coalesce(corr(conf, (true_tag = routed_tag)::INT::DOUBLE), 0), 4) FROM known
  HAVING coalesce(corr(conf, (true_tag = routed_tag)::INT::DOUBLE), 0) < 0.3
UNION ALL SELECT 'weak_tag', tag, round(f1_score, 4) FROM w WHERE f1_score < 0.5""")
def evaluation_recommendations(spark, sf):
    outcomes = ev.outcome_table(_routed(spark, sf), time_ms="time_ms")
    per_tag = ev.per_tag_metrics(ev.known_outcomes(outcomes, _known_tags(spark)))
    advice = rec.evaluation_recommendations(ev.metrics_from_outcomes(outcomes, _known_tags(spark)), per_tag)
    return advice.select("code", "about", F.round("value", 4).alias("value"))


# --- splits -----------------------------------------------------------------

_FOLDED = f"""WITH {inp.SQL_ROUTED},
folded AS (SELECT *, (row_number() OVER (PARTITION BY true_tag ORDER BY md5(note_id || ':42'), note_id) - 1) % 5 AS fold FROM routed),
known AS (SELECT * FROM folded WHERE true_tag IN ({_KNOWN_LIST}) AND routed_tag IN ({_KNOWN_LIST})),
{sql_per_tag('known', 'fold').strip()},
c AS (SELECT fold, coalesce(corr(conf, (true_tag = routed_tag)::INT::DOUBLE), 0) AS corr FROM known GROUP BY 1)"""


@_query("kfold_metrics", f"""{_FOLDED}
SELECT fold::INT AS fold, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, n,
  round(corr, 4) AS confidence_correlation FROM wm JOIN c USING (fold)""")
def kfold_metrics(spark, sf):
    notes = inp.labelled_vectors(spark, sf)
    index = rt.build_index(inp.centroid_tags(notes))
    out = ev.cross_validate(notes, _known_tags(spark), lambda d: rt.route(d, index))
    return _round(out, "precision", "recall", "f1_score", "confidence_correlation").select(
        "fold", "precision", "recall", "f1_score", "n", "confidence_correlation")


_TRAINED = f"""WITH folded AS (SELECT vec_id AS note_id, label::VARCHAR AS true_tag, embedding::DOUBLE[] AS v,
  ((row_number() OVER (PARTITION BY label::VARCHAR ORDER BY md5(vec_id || ':42'), vec_id) - 1) % 5)::INT AS fold FROM embeddings),
cells AS (SELECT fold, true_tag, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM folded),
sums AS (SELECT true_tag, fold, pos, sum(x) AS s, count(*) AS c FROM cells GROUP BY ALL),
means AS (SELECT f.fold, true_tag AS tag, pos, sum(s) / sum(c) AS m FROM sums JOIN (SELECT unnest(range(5)) AS fold) f ON sums.fold <> f.fold GROUP BY ALL),
centers AS (SELECT fold, tag, list(m ORDER BY pos) AS tv FROM means GROUP BY 1, 2),
scored AS (SELECT n.fold, note_id, true_tag, tag AS routed_tag,
  list_inner_product(v, tv) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(tv, tv)) AS sim FROM folded n JOIN centers c ON n.fold = c.fold),
routed AS (SELECT *, CASE WHEN sim >= 0.5::DOUBLE THEN 0.5 + 0.5 * (sim - 0.5::DOUBLE) / 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, sim) END AS conf
  FROM scored QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY round(sim, 12) DESC, routed_tag) = 1),
{sql_per_tag('routed', 'fold').strip()},
c AS (SELECT fold, coalesce(corr(conf, (true_tag = routed_tag)::INT::DOUBLE), 0) AS corr FROM routed GROUP BY 1)"""


@_query("kfold_trained", f"""{_TRAINED}
SELECT fold, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, n,
  round(corr, 4) AS confidence_correlation FROM wm JOIN c USING (fold)""")
def kfold_trained(spark, sf):
    """Tag vectors are the means of the other four folds."""
    notes = inp.labelled_vectors(spark, sf)
    out = ev.cross_validate_centroids(notes, notes.select(F.col("true_tag").alias("tag")).distinct())
    return _round(out, "precision", "recall", "f1_score", "confidence_correlation").select(
        "fold", "precision", "recall", "f1_score", "n", "confidence_correlation")


@_query("stratified_folds", """
SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id) - 1) % 5)::INT AS fold FROM documents""")
def stratified_folds(spark, sf):
    docs = inp.table(spark, sf, "documents").select("doc_id", "source")
    return ev.stratified_folds(docs, "source", "doc_id", seed=7)


@_query("stratified_split", """
SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id)
  <= count(*) OVER (PARTITION BY quality) - ceil(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE) AS is_train FROM labels""")
def stratified_split(spark, sf):
    return ev.stratified_split(inp.table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


# --- models -----------------------------------------------------------------

_MODELS = {"full-64": (1, 64), "head-32": (1, 32), "tail-16": (49, 64)}


def _model_results(spark, sf):
    notes = inp.labelled_vectors(spark, sf)
    tags = cut_lineage(inp.centroid_tags(notes))
    results = {}
    for i, (name, (low, high)) in enumerate(_MODELS.items()):
        part = F.slice("vector", low, high - low + 1)
        routed = rt.route(notes.withColumn("vector", part), rt.build_index(tags.withColumn("vector", part)))
        results[name] = routed.select(
            "note_id", "true_tag", "routed_tag", "similarity_score", "confidence",
            F.lit(high - low + 1).alias("embedding_dimension"),
            (F.lit(60.0 - 25 * i) + (F.col("note_id") % 3)).alias("time_ms"))
    return ev.union_models(results)


def _comparison(spark, sf):
    return ev.compare_models(_model_results(spark, sf), _known_tags(spark), "time_ms")


def _sql_models() -> str:
    ranked = ",\n".join(inp.sql_ranked(
        f"SELECT vec_id AS note_id, embedding[{low}:{high}]::DOUBLE[] AS v, label::VARCHAR AS true_tag FROM embeddings",
        f"SELECT tag, vector[{low}:{high}] AS tv FROM centroids", name=f"_{i}").strip()
        for i, (low, high) in enumerate(_MODELS.values()))
    union = " UNION ALL ".join(
        f"SELECT '{name}' AS model_name, {high - low + 1} AS embedding_dimension, {60.0 - 25 * i} + note_id % 3 AS time_ms, * FROM routed_{i}"
        for i, (name, (low, high)) in enumerate(_MODELS.items()))
    return f"""WITH {inp.SQL_CENTROIDS},
{ranked},
results AS ({union}),
known AS (SELECT * FROM results WHERE true_tag IN ({_KNOWN_LIST}) AND routed_tag IN ({_KNOWN_LIST})),
{sql_per_tag('known', 'model_name').strip()},
t AS (SELECT model_name, avg(time_ms) AS processing_time_ms, max(embedding_dimension) AS embedding_dimension FROM results GROUP BY 1),
cmp AS (SELECT model_name, precision, recall, f1_score, processing_time_ms, embedding_dimension,
  embedding_dimension * 4000 / 1048576.0::DOUBLE AS memory_usage_mb, 200.0::DOUBLE AS model_size_mb FROM wm JOIN t USING (model_name))"""


_CMP = _sql_models()


@_query("model_comparison", f"""{_CMP}
SELECT model_name, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1_score, 4) AS f1_score,
  round(processing_time_ms, 4) AS processing_time_ms, embedding_dimension, round(memory_usage_mb, 4) AS memory_usage_mb, model_size_mb FROM cmp""")
def model_comparison(spark, sf):
    out = ev.rank_models(_comparison(spark, sf))
    return _round(out, "precision", "recall", "f1_score", "processing_time_ms", "memory_usage_mb").select(
        "model_name", "precision", "recall", "f1_score", "processing_time_ms", "embedding_dimension",
        "memory_usage_mb", "model_size_mb")


@_query("best_model", f"""{_CMP}
(SELECT 'f1_score' AS criteria, model_name FROM cmp ORDER BY f1_score DESC, model_name LIMIT 1)
UNION ALL (SELECT 'precision', model_name FROM cmp ORDER BY precision DESC, model_name LIMIT 1)
UNION ALL (SELECT 'recall', model_name FROM cmp ORDER BY recall DESC, model_name LIMIT 1)
UNION ALL (SELECT 'speed', model_name FROM cmp ORDER BY processing_time_ms, model_name LIMIT 1)""")
def best_model(spark, sf):
    comparison = cut_lineage(_comparison(spark, sf))  # one row per model, read four times
    out = None
    for criteria in ("f1_score", "precision", "recall", "speed"):
        row = ev.best_model(comparison, criteria).select(F.lit(criteria).alias("criteria"), "model_name")
        out = row if out is None else out.unionByName(row)
    return out


@_query("select_model", f"""{_CMP}
SELECT model_name, embedding_dimension FROM cmp WHERE embedding_dimension >= 20 AND processing_time_ms <= 100 AND memory_usage_mb <= 0.2
ORDER BY f1_score DESC, model_name LIMIT 1""")
def select_model(spark, sf):
    out = ru.select_model(_comparison(spark, sf), min_dimension=20, max_time_ms=100.0, max_memory_mb=0.2)
    return out.select("model_name", "embedding_dimension")


@_query("model_tradeoff", f"""{_CMP},
r AS (SELECT *, row_number() OVER (ORDER BY f1_score DESC, model_name) AS rn FROM cmp)
SELECT a.model_name, round(a.f1_score, 4) AS f1_score, b.model_name AS second_model, round(b.f1_score, 4) AS second_f1,
  a.f1_score - b.f1_score < 0.05 AND b.processing_time_ms < a.processing_time_ms * 0.7 AS prefer_second
FROM r a JOIN r b ON a.rn = 1 AND b.rn = 2""")
def model_tradeoff(spark, sf):
    return _round(ev.model_tradeoff(_comparison(spark, sf)), "f1_score", "second_f1")


@_query("model_recommendations", f"""{_CMP},
r AS (SELECT *, row_number() OVER (ORDER BY f1_score DESC, model_name) AS rn FROM cmp)
SELECT 'all_models_weak' AS code, NULL AS about, round(f1_score, 4) AS value, 0.7::DOUBLE AS bound FROM r WHERE rn = 1 AND f1_score < 0.7
UNION ALL SELECT 'all_models_slow', NULL, round(min(processing_time_ms), 4), 50 FROM r HAVING min(processing_time_ms) >= 50
UNION ALL SELECT 'all_models_large', NULL, round(min(memory_usage_mb), 4), 500 FROM r HAVING min(memory_usage_mb) >= 500
UNION ALL SELECT 'strong_model', model_name, round(f1_score, 4), 0.8 FROM r WHERE rn = 1 AND f1_score > 0.8
UNION ALL SELECT 'bargain_model', b.model_name, round(a.f1_score - b.f1_score, 4), 0.05 FROM r a JOIN r b ON a.rn = 1 AND b.rn = 2
  WHERE a.f1_score - b.f1_score < 0.05 AND b.processing_time_ms < a.processing_time_ms * 0.7""")
def model_recommendations(spark, sf):
    return rec.model_recommendations(_comparison(spark, sf)).select("code", "about", F.round("value", 4).alias("value"), "bound")


# --- calibration ------------------------------------------------------------

def _scored(spark, sf):
    return cal.calibration_dataset(_routed(spark, sf))


@_query("calibration_dataset", f"""WITH {inp.SQL_ROUTED}
SELECT note_id, CASE WHEN note_id % 10 = 0 THEN 0.0::DOUBLE ELSE round(sim, 4) END AS score,
  CASE WHEN note_id % 10 = 0 THEN '' ELSE routed_tag END = CASE WHEN note_id % 15 = 0 THEN '' ELSE true_tag END AS correct FROM routed""")
def calibration_dataset(spark, sf):
    """Results without a score or tag, and notes without a known truth."""
    routed = _routed(spark, sf)
    gap = F.col("note_id") % 10 == 0
    results = routed.select("note_id", F.when(~gap, F.col("routed_tag")).alias("routed_tag"),
                            F.when(~gap, F.col("similarity_score")).alias("similarity_score"))
    truth = inp.labelled_vectors(spark, sf).filter(F.col("note_id") % 15 != 0)
    return cal.calibration_dataset(results, truth).select("note_id", F.round("score", 4).alias("score"), "correct")


@_query("brier_ece", f"""WITH {inp.SQL_ROUTED},
p AS (SELECT conf AS p, (true_tag = routed_tag)::INT::DOUBLE AS y FROM routed),
b AS (SELECT count(*) AS n, sum(y) AS ys, sum(p) AS ps FROM p WHERE p > 0 GROUP BY
  CASE WHEN p <= 0.1::DOUBLE THEN 1 WHEN p <= 0.2::DOUBLE THEN 2 WHEN p <= 0.30000000000000004::DOUBLE THEN 3 WHEN p <= 0.4::DOUBLE THEN 4
       WHEN p <= 0.5::DOUBLE THEN 5 WHEN p <= 0.6000000000000001::DOUBLE THEN 6 WHEN p <= 0.7000000000000001::DOUBLE THEN 7
       WHEN p <= 0.8::DOUBLE THEN 8 WHEN p <= 0.9::DOUBLE THEN 9 ELSE 10 END)
SELECT round(avg((p - y) * (p - y)), 4) AS brier_score, (SELECT round(sum(abs(ys - ps)) / (SELECT count(*) FROM p), 4) FROM b) AS expected_calibration_error,
  count(*) AS n FROM p""")
def brier_ece(spark, sf):
    return _round(cal.calibration_error(_scored(spark, sf), "confidence", "correct"),
                  "brier_score", "expected_calibration_error")


@_query("reliability_bins", f"""WITH {inp.SQL_ROUTED}
SELECT CASE WHEN conf <= 0.1::DOUBLE THEN 1 WHEN conf <= 0.2::DOUBLE THEN 2 WHEN conf <= 0.30000000000000004::DOUBLE THEN 3 WHEN conf <= 0.4::DOUBLE THEN 4
       WHEN conf <= 0.5::DOUBLE THEN 5 WHEN conf <= 0.6000000000000001::DOUBLE THEN 6 WHEN conf <= 0.7000000000000001::DOUBLE THEN 7
       WHEN conf <= 0.8::DOUBLE THEN 8 WHEN conf <= 0.9::DOUBLE THEN 9 ELSE 10 END AS bin, count(*) AS n,
  round(avg((true_tag = routed_tag)::INT), 4) AS fraction_of_positives, round(avg(conf), 4) AS mean_predicted_value FROM routed GROUP BY 1""")
def reliability_bins(spark, sf):
    return _round(cal.reliability_bins(_scored(spark, sf), "confidence", "correct"),
                  "fraction_of_positives", "mean_predicted_value")


@_query("calibrated_confidence", f"""WITH {inp.SQL_ROUTED}
SELECT note_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 / (1 + exp(-({A} * sim + {B}))) * CASE WHEN sim < 0.3::DOUBLE THEN sim / 0.3::DOUBLE ELSE 1 END)), 4) AS calibrated,
  round(conf, 4) AS unfitted FROM routed""")
def calibrated_confidence(spark, sf):
    score, limit = F.col("similarity_score"), F.lit(inp.VECTOR_THRESHOLD)
    return _routed(spark, sf).select(
        "note_id", F.round(cal.Calibrator(A, B).calibrate(score, limit), 4).alias("calibrated"),
        F.round(cal.Calibrator().calibrate(score, limit), 4).alias("unfitted"))


@_query("threshold_calibration", f"""WITH {inp.SQL_ROUTED}
SELECT note_id, round(CASE WHEN routed_tag::INT % 3 = 0 THEN 1 / (1 + exp(-8.0 * (sim - 0.25))) WHEN routed_tag::INT % 3 = 1 THEN 1 / (1 + exp(-5.0 * (sim - 0.3)))
  ELSE 1 / (1 + exp(-sim)) END, 4) AS calibrated FROM routed""")
def threshold_calibration(spark, sf):
    params = spark.createDataFrame([(0.3, 8.0, 0.25), (0.4, 5.0, 0.3)], "threshold double, slope double, midpoint double")
    kind = F.col("routed_tag").cast("int") % 3
    limits = F.when(kind == 0, 0.3).when(kind == 1, 0.4).otherwise(0.5)
    out = cal.calibrate_by_threshold(_routed(spark, sf).withColumn("threshold", limits), params)
    return out.select("note_id", F.round("calibrated", 4).alias("calibrated"))


# the same fit by Newton steps in a recursive query
_PLATT = f"""WITH RECURSIVE {inp.SQL_ROUTED.strip()},
scored AS (SELECT note_id, coalesce(round(sim, 12), 0) AS s, (coalesce(routed_tag, '') = coalesce(true_tag, ''))::INT::DOUBLE AS y, conf FROM routed),
train AS (SELECT s, y FROM scored QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5(note_id || ':42'), note_id)
  <= count(*) OVER (PARTITION BY y) - ceil(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE)),
newton(step, a, b) AS (
  SELECT 0, 0.0::DOUBLE, ln(avg(y) / (1 - avg(y))) FROM train
  UNION ALL
  SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT step, a, b, sum((p - y) * s) + a AS ga, sum(p - y) AS gb, sum(p * (1 - p) * s * s) + 1 AS haa,
      sum(p * (1 - p) * s) AS hab, sum(p * (1 - p)) AS hbb
    FROM (SELECT n.*, t.s, t.y, 1 / (1 + exp(-(n.a * t.s + n.b))) AS p FROM newton n, train t WHERE n.step < 12) GROUP BY step, a, b)),
fit AS (SELECT a, b FROM newton WHERE step = 12)"""


@_query("platt_fit", f"""{_PLATT}
SELECT 'platt' AS method, true AS is_fitted, round(b, 4) AS intercept, round(a, 4) AS coefficient,
  true AS gradient_vanishes FROM fit""")
def platt_fit(spark, sf):
    """Fitted, saved, loaded again, and its gradient over the training part taken."""
    data = _scored(spark, sf).select("note_id", "score", "correct")
    path = scratch_path(spark, "calibrator")
    wr.save_calibrator(spark, cal.fit_platt(data), path)
    fitted = wr.load_calibrator(spark, path)
    _, g_a, g_b, *_ = cal.newton_sums(cal.training_part(data), fitted.coefficient, fitted.intercept)
    return fitted.to_df(spark).select(
        "method", "is_fitted", F.round("parameters.intercept", 4).alias("intercept"),
        F.round("parameters.coefficient", 4).alias("coefficient"),
        F.lit(max(abs(g_a), abs(g_b)) < 1e-4).alias("gradient_vanishes"))


@_query("platt_report", f"""{_PLATT},
p AS (SELECT s, y, conf, 1 / (1 + exp(-(a * s + b))) AS p FROM scored, fit)
SELECT round(avg((s - y) * (s - y)), 4) AS brier_score_before, round(avg((p - y) * (p - y)), 4) AS brier_score_after,
  count(*) AS n FROM p""")
def platt_report(spark, sf):
    data = cut_lineage(_scored(spark, sf).select("note_id", "score", "correct"))
    out = cal.calibration_report(data, cal.fit_platt(data))
    return _round(out, "brier_score_before", "brier_score_after")


@_query("destination_metrics", f"""WITH {inp.SQL_ROUTED}
SELECT routed_tag, count(*) AS decisions, round(avg(note_id % 7), 4) AS average_decision_time, round(avg((true_tag = routed_tag)::INT), 4) AS routing_accuracy,
  0.0::DOUBLE AS error_rate, round(count(*) / (SELECT count(*) FROM routed)::DOUBLE, 4) AS utilization FROM routed GROUP BY 1""")
def destination_metrics(spark, sf):
    out = ob.destination_metrics(_routed(spark, sf), "routed_tag", "time_ms",
                                 F.col("true_tag") == F.col("routed_tag"), F.col("routed_tag") == "error")
    return _round(out, "average_decision_time", "routing_accuracy", "utilization")
