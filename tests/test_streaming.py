"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from notemill.operators import notes as nt
from notemill.operators import routing as rt
from notemill.operators.embedding import embed_hashed, tag_definition_vectors
from notemill.sources import ontology as on
from notemill.sources import readers as rd
from notemill.sources import writers as wr
from notemill.streaming import streams as st

RUN = "2025-01-31T00:00:00"


def test_lines_to_routes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("#todo_item need to fix the login bug\n\nplain text here\n")
    (tmp_path / "in" / "b.txt").write_text("#idea #x build a search engine //later\n")
    index = rt.build_index(tag_definition_vectors(on.default_tags(spark), embed_hashed))

    def routed(lines):
        parsed = nt.parse_capture(lines, run_ts=RUN).withColumn("text", F.col("body"))
        return parsed, embed_hashed(parsed)

    columns = ["raw_text", "routed_tag", "valid"]
    _, vectors = routed(rd.stream_text(spark, str(tmp_path / "in")))
    streamed = st.run_available(st.route_stream(vectors, index).select(columns))
    _, vectors = routed(rd.read_capture_lines(spark, str(tmp_path / "in")))
    batch = rt.route(vectors, index).select(columns)
    assert sorted(streamed.collect()) == sorted(batch.collect()) and streamed.count() == 3

    parsed, _ = routed(rd.stream_text(spark, str(tmp_path / "in")))
    st.start_fan_out(parsed, f"{tmp_path}/out", f"{tmp_path}/state", available_now=True).awaitTermination()
    assert sorted(r["tag"] for r in wr.read_by_tag(spark, f"{tmp_path}/out").collect()) == [
        "idea", "todo_item", "untagged", "x"]


def test_restart_reads_only_new_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one\n")
    for name, want in (("b.txt", 2), ("c.txt", 3)):
        (folder / name).write_text("more\n")
        lines = rd.stream_text(spark, str(folder))
        st.start_append(lines, f"{tmp_path}/o", f"{tmp_path}/s", available_now=True).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/o").count() == want


def test_late_rows_and_duplicates(spark, tmp_path):
    schema = "ts timestamp, text string"
    rows = [("2024-01-01 00:00:00", "Hello"), ("2024-01-01 00:00:10", "hello "), ("2024-01-01 00:00:20", "other")]
    spark.createDataFrame(rows, "ts string, text string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.json(
        f"{tmp_path}/in")
    stream = rd.stream_json(spark, f"{tmp_path}/in", schema)
    got = st.run_available(st.deduplicate_stream(stream, "ts"))
    assert sorted(r["text"].strip().lower() for r in got.collect()) == ["hello", "other"]


def test_batch_input_is_refused(spark):
    index = rt.build_index(tag_definition_vectors(on.default_tags(spark), embed_hashed))
    notes = embed_hashed(spark.createDataFrame([("x",)], "text string"))
    try:
        st.route_stream(notes, index)
        raise AssertionError("a batch input must be refused")
    except ValueError:
        pass
