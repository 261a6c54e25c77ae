"""Calibrator fits, principal axes, folds, votes, keep-first, stalled notes, stream sinks."""

import glob
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.functions import text as tx
from notemill.operators import calibration as cal
from notemill.operators import embedding as em
from notemill.operators import notes as nt
from notemill.operators import routing as rt
from notemill.sources import readers as rd
from notemill.streaming import streams as st


def test_fits_of_one_outcome_and_of_none(spark):
    schema = "note_id int, score double, correct boolean"
    assert not cal.fit_platt(spark.createDataFrame([], schema)).is_fitted
    ones = cal.fit_platt(spark.createDataFrame([(i, i / 10, True) for i in range(10)], schema))
    assert ones.coefficient == 0.0 and ones.intercept == pytest.approx(math.log(9 / 1))   # eight of ten are fitted
    odd = spark.createDataFrame([(i, i / 10, i > 4) for i in range(10)] + [(20, None, True), (21, float("nan"), True), (22, 0.1, None)], schema)
    assert cal.fit_platt(odd) == cal.fit_platt(odd.filter("note_id < 20"))


def test_separable_scores_converge(spark):
    """The penalty keeps the coefficient finite, and steps that would raise the loss are halved."""
    data = spark.createDataFrame([(i, 1000.0 * (i % 2), i % 2 == 1) for i in range(50)], "note_id int, score double, correct boolean")
    fitted = cal.fit_platt(data)
    _, g_a, g_b, *_ = cal.newton_sums(cal.training_part(data), fitted.coefficient, fitted.intercept)
    assert abs(g_a) < 1e-4 and abs(g_b) < 1e-4 and 0 < fitted.coefficient < 1


def test_principal_axes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ np.diag([4, 3, 2, 1, 0.1]) + 1e6
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, vector array<double>").repartition(4)
    axes = em.fit_axes(rows)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(axes.variances, values[::-1], rtol=1e-6)
    assert np.allclose(np.abs(axes.components @ vectors[:, ::-1]), np.eye(5), atol=1e-6)
    got = {r["id"]: r["reduced"] for r in em.reduce_dimensions(rows, 2).collect()}
    assert got.pop(999) is None and len(got[0]) == 2
    want = (x - x.mean(0)) @ axes.components[:2].T
    assert np.allclose(np.array([got[i] for i in range(300)]), want, atol=1e-6)
    with pytest.raises(ValueError):
        em.fit_axes(rows.limit(0))


def test_means_without_a_fold(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [3.0, 2.0]), ("a", 1, [5.0, 4.0]), ("b", 2, [7.0, 7.0]),
                                  ("b", 2, None)], "tag string, fold int, vector array<double>")
    got = {(r["fold"], r["tag"]): (r["vector"], r["n"]) for r in em.leave_one_out_means(rows, "tag", "fold", 3).collect()}
    assert got == {(0, "a"): ([4.0, 3.0], 2), (1, "a"): ([1.0, 0.0], 1), (2, "a"): ([3.0, 2.0], 3),
                   (0, "b"): ([7.0, 7.0], 1), (1, "b"): ([7.0, 7.0], 1)}   # b has no row outside fold 2


def test_routes_by_fold(spark):
    notes = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 0, None), (4, 9, [1.0, 0.0])],
                                  "note_id int, fold int, vector array<double>")
    tags = spark.createDataFrame([(0, "x", [1.0, 0.0]), (0, "y", [0.0, 1.0]), (1, "y", [1.0, 0.1]), (1, "z", [0.0, 1.0])],
                                 "fold int, tag string, vector array<double>")
    got = {r["note_id"]: (r["routed_tag"], round(r["similarity_score"], 3)) for r in rt.route_by_fold(notes, tags).collect()}
    assert got == {1: ("x", 1.0), 2: ("y", 0.995), 3: ("error", 0.0), 4: ("error", 0.0)}
    with pytest.raises(ValueError):
        rt.route_by_fold(notes, tags, max_broadcast_bytes=8)


def test_votes(spark):
    schema = "votes array<struct<tag:string,similarity:double>>"
    cases = [([("a", .1), ("b", .9), ("a", .2)], ("a", 2)), ([("a", .1), ("b", .9), ("c", .2)], ("b", 1)),
             ([("b", .5), ("a", .5)], ("a", 1)), ([("error", 0.0)], ("error", 1))]
    rows = spark.createDataFrame([(v,) for v, _ in cases], schema).coalesce(1).select(rt.vote(F.col("votes")).alias("w")).collect()
    assert [(r["w"]["routed_tag"], r["w"]["votes"]) for r in rows] == [w for _, w in cases]


def test_keep_first_and_last(spark):
    rows = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("x", 1, "b"), (None, 5, "d"), (None, 4, "e"), ("y", None, "f")],
                                 "k string, at int, v string").repartition(4)
    first = {r["k"]: (r["at"], r["v"]) for r in nt.keep_first(rows, ["k"], "at").collect()}
    assert first.pop("x") in ((1, "a"), (1, "b")) and first == {None: (4, "e"), "y": (None, "f")}
    assert {r["k"]: r["v"] for r in nt.keep_last(rows, ["k"], "at").collect()} == {"x": "c", None: "d", "y": "f"}
    two = nt.keep_first(rows.withColumn("z", F.lit(None).cast("int")), ["k", "z"], "at").collect()
    assert len(two) == 3
    assert nt.keep_first(rows.filter("false"), ["k"], "at").collect() == []


def test_bytes_that_are_not_utf8(spark):
    rows = spark.createDataFrame([(1, b"a\xffb <b>"), (2, "é".encode()), (3, None)], "id int, b binary")
    got = {r["id"]: (r["s"]["content"], r["s"]["valid"]) for r in rows.select("id", tx.sanitize_bytes(F.col("b")).alias("s")).collect()}
    assert got == {1: ("a�b &lt;b&gt;", False), 2: ("é", True), 3: (None, None)}


# --- streams ----------------------------------------------------------------

def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_islands():
    run = lambda a, b, n=1, s="x", e=False: (a, b, n, s, e)
    assert st.merge_islands([run(30, 30), run(10, 10), run(15, 15, s="y", e=True)], 5) == [(10, 15, 2, "y", True), run(30, 30)]
    assert st.merge_islands([run(0, 9), run(4, 5, 3)], 0) == [(0, 9, 4, "x", False)]


def test_stalled_notes_are_reported_while_they_are_quiet(spark, tmp_path):
    """Over several runs: an open session waits, a quiet note is told once the watermark has passed."""
    schema = "ts timestamp, note_id int, event_type string"
    event = lambda minute, note, kind="note.created": {"ts": f"2025-01-01 {minute // 60:02d}:{minute % 60:02d}:00", "note_id": note, "event_type": kind}
    stream = lambda: st.stalled_notes(rd.stream_json(spark, f"{tmp_path}/in", schema), "ts")
    told = []
    for k, rows in enumerate([[event(0, 1), event(3, 1), event(0, 2), event(4, 2, "note.processed")],
                              [event(8, 1), event(60, 3)], [event(200, 4), event(30, 1)]]):
        _write(tmp_path / "in", f"{k}.json", rows)
        q = st.start_append(stream(), f"{tmp_path}/out", f"{tmp_path}/state", available_now=True)
        q.awaitTermination()
        seen = spark.read.schema("note_id int, n bigint, status string, timed_out boolean").parquet(f"{tmp_path}/out").collect()
        told.append(sorted((r["note_id"], r["n"], r["timed_out"]) for r in seen))
    assert told[0] == []
    assert told[1] == [(1, 3, True), (2, 2, False)]
    # the event of minute 30 came after the watermark (minute 50) and is dropped; note 3 has stalled, note 4 is open
    assert told[2] == [(1, 3, True), (2, 2, False), (3, 1, True)]


def test_fan_out_has_few_files_and_replaces_a_batch(spark, tmp_path):
    schema = "note_id int, raw_text string"
    for k in range(2):
        _write(tmp_path / "in", f"{k}.json", [{"note_id": i, "raw_text": f"#t{i % 3} #all text {k} {i}"} for i in range(400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for _ in range(2):   # with a fresh checkpoint the same batch is run again
            state = f"{tmp_path}/state{_}"
            st.start_fan_out(nt.parse_capture(rd.stream_json(spark, f"{tmp_path}/in", schema), run_ts="2025-01-01T00:00:00"),
                             f"{tmp_path}/out", state, available_now=True, files_per_tag=2).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for tag in ("t0", "t1", "t2", "all"):
        assert 1 <= len(glob.glob(f"{tmp_path}/out/tag_dir={tag}/batch=0/*.json")) <= 2
    from notemill.sources import writers as wr

    assert wr.read_by_tag(spark, f"{tmp_path}/out").count() == 2 * 800


def test_first_arrivals_over_all_runs(spark, tmp_path):
    schema = "note_id int, text string"
    runs = [[(1, "Hello"), (2, "hello "), (3, "other")], [(4, "HELLO"), (5, "new"), (6, None)], [(7, "new"), (8, "Other")]]
    for k, rows in enumerate(runs):
        _write(tmp_path / "in", f"{k}.json", [{"note_id": i, "text": t} for i, t in rows])
        notes = rd.stream_json(spark, f"{tmp_path}/in", schema)
        st.start_deduplicated(notes, f"{tmp_path}/out", f"{tmp_path}/state", order_by="note_id", available_now=True).awaitTermination()
    kept = st.read_deduplicated(spark, f"{tmp_path}/out", notes.schema)
    assert sorted(map(tuple, kept.collect())) == [(1, "Hello"), (3, "other"), (5, "new")]


def test_scores_without_a_known_tag_are_refused(spark):
    from notemill.operators import evaluation as ev

    rows = spark.createDataFrame([("x", "y", 0.5)], "true_tag string, routed_tag string, confidence double")
    with pytest.raises(Exception, match="no row has known tags"):
        ev.evaluate(rows, spark.createDataFrame([("a",)], "tag string")).collect()
    assert ev.evaluate(rows.withColumn("fold", F.lit(1)), spark.createDataFrame([("a",)], "tag string"), by=["fold"]).collect() == []
