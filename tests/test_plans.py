"""The shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import notes as nt
from notemill.operators import routing as rt
from notemill.operators import validation as va
from notemill.operators.embedding import embed_hashed
from notemill.plans import catalog
from notemill.runtime import broadcast_if_small, checkpoint_root, scratch_path
from notemill.sources import readers as rd


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_row_work_needs_no_shuffle(spark, documents):
    lines = documents.select("doc_id", F.concat(F.lit("#"), "lang", F.lit(" "), "text").alias("raw_text"))
    parsed = nt.parse_capture(lines)
    tags = spark.createDataFrame([("a", [1.0] * 64), ("b", [-1.0] * 64)], "tag string, vector array<double>")
    routed = rt.route(embed_hashed(parsed.withColumn("text", F.col("body"))),
                      rt.build_index(tags, threshold=None))
    notes = documents.select("text", F.col("doc_id").cast("string").alias("note_id"), F.lit("x").alias("timestamp"))
    for df in (parsed, routed, va.validate_notes(notes), nt.filter_by_length(documents)):
        assert "Exchange" not in _plan(df)
    # hashing and routing share one Python stage
    assert _plan(routed).count("ArrowEvalPython") == 1


def test_scans_are_pruned(documents):
    plan = _plan(rd.get_note(documents, 5, "doc_id").select("doc_id", "lang"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert "EqualTo(doc_id,5)" in plan


def test_copies_merge_before_the_shuffle(documents):
    plan = _plan(nt.deduplicate_notes(documents, "doc_id"))
    assert "SortAggregate" not in plan and plan.count("partial_min") == 1
    # digests and order values are the shuffle keys, never a text
    assert all("text" not in line.split("ENSURE")[0] for line in plan.splitlines() if "hashpartitioning" in line)
    assert "SortAggregate" not in _plan(va.validate_notes_batch(documents.select(
        "doc_id", "text", F.lit("a").alias("note_id"), F.lit("x").alias("timestamp")), "doc_id"))


def test_tag_vectors_are_in_no_single_task(spark, sf_dir):
    lines = _plan(catalog.QUERIES["route_topk_blocked"](spark, sf_dir)).splitlines()
    # what meets in one task is a count a partition
    assert all("HashAggregate" in below and "count(1)" in below for line, below in zip(lines, lines[1:]) if "SinglePartition" in line)


def test_votes_need_no_shuffle(spark, sf_dir):
    plan = _plan(catalog.QUERIES["ensemble_vote"](spark, sf_dir))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython [") <= 1


@pytest.mark.parametrize("name", ["route_topk_blocked", "similarity_search", "confusion_matrix", "length_outliers",
                                  "trailing_error_rate", "trailing_avg", "latency_percentiles", "kfold_metrics",
                                  "evaluate_routing", "batch_cosine", "ensemble_vote"])
def test_no_cross_join(spark, sf_dir, name):
    plan = _plan(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_broadcast_is_checked(spark):
    df = spark.range(100)
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, max_rows=10)._jdf.queryExecution().logical().toString().lower()


def test_scratch_lies_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == named and scratch_path(spark, "x").startswith(named)
