"""Readers, writers, ontology and generator."""

import json

import pytest
from pyspark.sql import functions as F

from notemill.operators import notes as nt
from notemill.sources import ontology as on
from notemill.sources import readers as rd
from notemill.sources import synth
from notemill.sources import writers as wr

RUN = "2025-01-31T00:00:00"


def _write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_csv(spark, tmp_path):
    path = _write(tmp_path / "n.csv", 'id,text,when\n1,"Hello, ""World""!",2025-01-01\n2,"two\nlines",x\n3,,y\n4,"  ",z\n')
    rows = rd.read_csv_notes(spark, path, "text", "id", "when").orderBy("note_id").collect()
    assert [(r["note_id"], r["text"], r["timestamp"]) for r in rows] == [
        ("1", "hello, world.", "2025-01-01"), ("2", "two lines", "x")]
    assert rows[0]["original_text"] == 'Hello, "World"!' and rows[0]["source_file"].endswith("n.csv")
    first = rd.read_csv_notes(spark, path, run_ts=RUN).orderBy("text").collect()
    again = rd.read_csv_notes(spark, path, run_ts=RUN).orderBy("text").collect()
    assert first == again and len({r["note_id"] for r in first}) == 2 and first[0]["timestamp"] == RUN
    assert rd.read_csv_notes(spark, path, "nope").count() == 0
    assert rd.read_csv_notes(spark, str(tmp_path / "absent.csv")).count() == 0


def test_text_and_markdown(spark, tmp_path):
    path = _write(tmp_path / "n.txt", "one\n\n two \nthree")
    assert sorted(r["text"] for r in rd.read_text_notes(spark, path).collect()) == ["one", "three", "two"]
    path = _write(tmp_path / "m.txt", "a;b; ;c")
    assert rd.read_text_notes(spark, path, ";").count() == 3
    path = _write(tmp_path / "n.md", "# Title\n\npara one\nline\n\n\n\n#tag gone\n\n  para two")
    assert sorted(r["text"] for r in rd.read_markdown_notes(spark, path).collect()) == ["para one line", "para two"]
    assert rd.read_markdown_notes(spark, str(tmp_path / "no.md")).count() == 0


def test_json_folder_lines(spark, tmp_path):
    path = _write(tmp_path / "n.json", json.dumps([{"text": "A", "x": 1}, {"text": "B!"}, {"other": 1}]))
    assert sorted(r["text"] for r in rd.read_json_notes(spark, path).collect()) == ["a", "b."]
    (tmp_path / "d" / "work").mkdir(parents=True)
    (tmp_path / "d" / "work" / "plan.txt").write_text("first\nsecond")
    (tmp_path / "d" / "skip.csv").write_text("x")
    row = rd.read_note_folder(spark, str(tmp_path / "d")).collect()
    assert [(r["title"], r["category"], r["content"]) for r in row] == [("plan", "work", "first\nsecond")]
    path = _write(tmp_path / "cap.txt", "#a x\n\n  \n#b y\n")
    assert [r["raw_text"] for r in rd.read_capture_lines(spark, path).collect()] == ["#a x", "#b y"]


def test_labelled_round_trip(spark, tmp_path):
    notes = synth.generate_notes(spark, 50)
    assert notes.collect() == synth.generate_notes(spark, 50).collect()
    assert notes.filter(F.contains("text", F.lit("{"))).count() == 0
    wr.write_csv(notes, f"{tmp_path}/lab")
    back = rd.read_labelled_notes(spark, f"{tmp_path}/lab")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, notes.collect()))
    assert notes.select("true_tag").distinct().count() > 4


def test_lookups(spark):
    notes = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "a", 7)], "note_id int, category string, created_at int")
    assert rd.get_note(notes, 2).count() == 1 and rd.get_note(notes, 9).count() == 0
    assert [r["note_id"] for r in rd.notes_by_category(notes, "a").collect()] == [3, 1]
    assert [r["note_id"] for r in rd.first_notes(notes, "note_id", 2).collect()] == [1, 2]


def test_ontology(spark, tmp_path):
    tags = on.default_tags(spark)
    assert on.tag_names(tags).count() == 8
    assert on.tag_by_name(tags, "todo_item").first()["confidence_threshold"] == 0.8
    assert on.tag_by_name(tags, "none").count() == 0
    tags.write.parquet(f"{tmp_path}/t.parquet")
    assert sorted(on.load_tags(spark, f"{tmp_path}/t.parquet").collect()) == sorted(tags.collect())
    config = [{"tag": "x", "description": " d \n", "examples": ["e"], "confidence_threshold": 1}]
    assert on.tags_from_config(spark, config).first()["description"] == "d"
    path = _write(tmp_path / "t.json", json.dumps([{"tag": "x", "description": "d"}]))
    with pytest.raises(ValueError):
        on.load_tags(spark, path)
    with pytest.raises(Exception):
        on.load_tags(spark, str(tmp_path / "absent.json"))


def test_by_tag_sink(spark, tmp_path):
    lines = spark.createDataFrame([(1, "#a #b one"), (2, "two"), (3, "#a three //c")], "note_id int, raw_text string")
    parsed = nt.parse_capture(lines, run_ts=RUN)
    wr.write_by_tag(parsed, f"{tmp_path}/out")
    wr.write_by_tag(parsed, f"{tmp_path}/out")  # appends
    back = wr.read_by_tag(spark, f"{tmp_path}/out")
    assert {(r["tag"], r["n"]) for r in back.groupBy("tag").agg(F.count("*").alias("n")).collect()} == {
        ("a", 4), ("b", 2), ("untagged", 2)}
    assert wr.read_by_tag(spark, f"{tmp_path}/out", "a").count() == 4
    assert back.filter("tag <> tag_dir").count() == 0


def test_records_and_exports(spark, tmp_path):
    rec = spark.createDataFrame([('{"body": "x"}',)], "record string")
    row = wr.from_record(rec).first()
    assert (row["tags"], row["body"], row["comment"], row["valid"], row["metadata"]) == ([], "x", None, False, {})
    routed = spark.createDataFrame([(1, "t", 0.5, 0.25, "hello")],
                                   "note_id int, routed_tag string, confidence double, similarity_score double, text string")
    wr.write_markdown(routed, f"{tmp_path}/md")
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/md/routed_tag=t").collect())
    assert text.startswith("---\nnote_id: 1\ntag: t\nconfidence: 0.5000") and text.endswith("hello")
    stored = spark.createDataFrame([("p", "x"), ("q", "y")], "path string, content string").select(
        "path", F.sha2("content", 256).alias("content_hash"))
    now = spark.createDataFrame([("p", "x"), ("q", "changed")], "path string, content string")
    assert [r["path"] for r in wr.verify_hashes(stored, now).collect()] == ["q"]
