"""Records that cross byte ranges, and their numbers, however a file is cut."""

import csv
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.sources import readers as rd
from notemill.sources.records import JsonArray, QuotedLines, numbered_lines, read_records


@pytest.fixture
def ranges(spark):
    """Sets the size of byte ranges."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def cut(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[2], "1")

    yield cut
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


ODD = ['}', '{', '"', '\\', '\\"', 'a}\n{b', '[{"x": "}"}]', "é\U0001F600", "", " ", "]," * 9, "\\\\}", "z" * 700]


def _objects(n=120):
    rng = np.random.default_rng(5)
    return [{"text": f"{i} " + "".join(rng.choice(ODD, 3)), "nest": {"a": [1, {"b": "}"}], "text": "inner"}} for i in range(n)]


@pytest.mark.parametrize("size", [64, 500, 5000, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_array(spark, tmp_path, ranges, size, indent):
    items = _objects()
    (tmp_path / "a.json").write_text("\n" + json.dumps(items, indent=indent, ensure_ascii=bool(indent)) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text('[{"text": "only"}]')
    ranges(size)
    rows = read_records(spark, str(tmp_path)).collect()
    got = {(r["file"][-6:], r["number"]): json.loads(r["record"]) for r in rows}
    assert len(rows) == len(got) == 121 and got["c.json", 0] == {"text": "only"}
    assert [got["a.json", i] for i in range(120)] == items


def test_one_file_is_read_by_several_tasks(spark, tmp_path, ranges):
    (tmp_path / "a.json").write_text(json.dumps(_objects(400)))
    ranges(4096)
    notes = rd.read_json_notes(spark, str(tmp_path / "a.json"), run_ts="x")
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 8
    few = {r["note_id"]: r["text"] for r in notes.collect()}
    ranges(1 << 27)
    assert {r["note_id"]: r["text"] for r in rd.read_json_notes(spark, str(tmp_path / "a.json"), run_ts="x").collect()} == few
    assert len(few) == 400


@pytest.mark.parametrize("size", [40, 333, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv(spark, tmp_path, ranges, size, end):
    rng = np.random.default_rng(6)
    rows = [[str(i), "".join(rng.choice(['"', ",", "\n", "a", " b", "é", "x\ny", '""'], 4)) + "."] for i in range(90)]
    sink = io.StringIO()
    csv.writer(sink, lineterminator=end).writerows([["id", "text"], *rows])
    (tmp_path / "n.csv").write_text(sink.getvalue(), encoding="utf-8", newline="")
    (tmp_path / "m.csv").write_text("id,text\n900,last without end", newline="")
    ranges(size)
    got = {r["row"]["id"]: r["row"]["text"] for r in rd.read_csv_records(spark, str(tmp_path)).collect()}
    assert got == {**dict(rows), "900": "last without end"}
    numbers = sorted(r["number"] for r in read_records(spark, str(tmp_path / "n.csv"), QuotedLines).collect())
    assert numbers == list(range(91))


def test_ids_do_not_depend_on_the_ranges(spark, tmp_path, ranges):
    lines = [f"line {i % 7}" for i in range(300)] + ["", "last"]
    (tmp_path / "n.txt").write_text("\n".join(lines))
    found = []
    for size in (50, 1 << 27):
        ranges(size)
        assert [r["value"] for r in numbered_lines(spark, str(tmp_path / "n.txt")).orderBy("number").collect()] == lines
        found.append({r["note_id"] for r in rd.read_text_notes(spark, str(tmp_path / "n.txt"), run_ts="x").collect()})
    assert found[0] == found[1] and len(found[0]) == 301   # repeated lines have ids of their own


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    assert read_records(spark, str(tmp_path / "e.json"), JsonArray).collect() == []
    assert rd.read_csv_records(spark, str(tmp_path / "e.json")) is None
    assert rd.read_json_notes(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "d.csv").write_text("a,A\n1,2\n")
    assert rd.read_csv_notes(spark, str(tmp_path / "d.csv"), "a").count() == 0   # names that Spark cannot tell apart
    assert rd.read_labelled_notes(spark, str(tmp_path / "none.csv")).filter(F.lit(True)).count() == 0
