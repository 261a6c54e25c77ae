"""Rows with NULL keys, odd windows, folder tables and both ways of size switches."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import observability as ob
from notemill.operators import ordering as od
from notemill.operators import routing as rt
from notemill.plans import inputs, queries_stream


def test_null_partition_keeps_its_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), (None, 5)], "k string, id int")
    got = od.hashed_row_number(rows.withColumn("o", F.md5(F.col("id").cast("string"))), "k", "o", "id", "n", total="size")
    assert sorted((r["k"] or "", r["n"], r["size"]) for r in got.collect()) == [
        ("", 1, 3), ("", 2, 3), ("", 3, 3), ("a", 1, 2), ("a", 2, 2)]


def test_trailing_count_of_null_keys_and_odd_windows(spark):
    rows = spark.createDataFrame([("x", "2025-01-01 00:00:00.000000"), ("x", "2025-01-01 00:00:00.999990"),
                                  (None, "2025-01-01 00:00:05"), (None, "2025-01-01 00:00:06")], "k string, s string")
    got = od.trailing_time_count(rows.withColumn("ts", F.to_timestamp("s")), "k", "ts", 1, "n").collect()
    assert sorted((r["k"] or "", r["s"], r["n"]) for r in got) == [
        ("", "2025-01-01 00:00:05", 1), ("", "2025-01-01 00:00:06", 2),
        ("x", "2025-01-01 00:00:00.000000", 1), ("x", "2025-01-01 00:00:00.999990", 2)]


def test_latency_of_a_null_operation(spark):
    rows = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "op string, v double")
    got = {r["op"]: r["total_processed"] for r in ob.latency_summary(rows, "op", "v").collect()}
    assert got == {"a": 1, None: 2}


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_both_ways_of_a_search_leave_null_vectors_out(spark, bound):
    notes = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "note_id bigint, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, vector array<double>")
    got = rt.similarity_search(notes, queries, 5, 0.0, max_broadcast_bytes=bound).collect()
    assert [r["match_note_id"] for r in got] == [1]


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_both_ways_of_routing_keep_repeated_ids_apart(spark, bound):
    tags = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "tag string, vector array<double>")
    notes = spark.createDataFrame([(1, [1.0, 0.1]), (1, [0.1, 1.0])], "note_id bigint, vector array<double>")
    got = rt.route(notes, rt.build_index(tags, threshold=None), top_k=1, max_broadcast_bytes=bound).collect()
    assert sorted(r["routed_tag"] for r in got) == ["x", "y"]


def test_streams_read_tables_of_several_files(spark, sf_dir, tmp_path):
    events = inputs.table(spark, sf_dir, "events")
    events.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    stream = queries_stream._stream(spark, str(tmp_path), "events")
    query = stream.writeStream.format("memory").queryName("all_events").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("all_events").count() == events.count()


def test_tables_are_read_without_a_shuffle(spark, sf_dir):
    for name in ("documents", "pages", "conversations"):
        assert "Exchange" not in inputs.table(spark, sf_dir, name)._jdf.queryExecution().executedPlan().toString()
