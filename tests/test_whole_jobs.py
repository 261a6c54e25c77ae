"""Queries whose rows must come from the whole of their input."""

import glob

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from notemill.operators import embedding as em
from notemill.operators import recommendations as rec
from notemill.sources import readers as rd
from notemill.sources import writers as wr


def test_tags_of_all_captured_notes_are_counted(spark, tmp_path):
    docs = [(i, f"whole text {i} of the note", "en" if i % 2 else "de", f"src{i % 3}", 20) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    rows = {r["tag"]: r["count"] for r in entry.queries()["tag_correlation"](spark, str(tmp_path)).collect()}
    # every fifth line has no tags; some stand a second time without a body
    tagged = [d for i in range(40) if i % 5 != 4 for d in [docs[i]] * (1 + (i % 13 == 5))]
    assert rows == {t: sum(t in d[2:4] for d in tagged) for t in ("en", "de", "src0", "src1", "src2")}


def test_all_ignored_tags_are_named(spark):
    capture = spark.createDataFrame([(0, 2.0)], "invalid_notes long, avg_tags_per_note double")
    routing = spark.createDataFrame([(1.0, 0.9)], "success_rate double, avg_confidence double")
    rates = [("a", 4, 0.0), ("b", 9, 0.1), ("c", 5, 0.2), ("d", 5, 0.0), ("e", 3, 0.4), ("few", 2, 0.0), ("kept", 9, 0.5)]
    correlations = spark.createDataFrame(rates, "tag string, count long, correlation_rate double")
    told = rec.integration_recommendations(capture, routing, correlations).collect()
    assert [(r["code"], r["value"], r["about"]) for r in told] == [("ignored_tags", 5.0, "b, c, d, a, e")]


def test_large_csv_is_dealt_over_files_of_bounded_bytes(spark, tmp_path):
    rows = [(i, f'line "{i}"\nand, more ' * 20, "en" if i % 2 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    read = []
    for name, size in (("one", None), ("many", 20_000)):
        wr.write_large_csv(docs, f"{tmp_path}/{name}", size)
        notes = rd.read_csv_notes(spark, f"{tmp_path}/{name}", "text", "doc_id", "lang")
        read.append(sorted(map(tuple, notes.select("note_id", "original_text", "timestamp").collect()), key=str))
    assert read[0] == read[1] and len(read[0]) == 300
    assert len(glob.glob(f"{tmp_path}/one/*.csv")) == 1 and len(glob.glob(f"{tmp_path}/many/*.csv")) > 4


def test_a_model_gets_texts_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(em, "MAX_TEXT", 1000)
    most = em.MAX_TEXT

    def load():
        def encode(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= most
            return np.array([[len(t), t.count("b")] for t in texts], dtype="float64")
        return encode

    texts = ["ab" * (i % 400) for i in range(900)] + [None, "b" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got = {r["doc_id"]: r["vector"] for r in em.embed_with_model(docs, load).collect()}
    assert got == {i: None if t is None else [len(t), t.count("b")] for i, t in enumerate(texts)}


def test_bucket_counts_do_not_depend_on_slices(spark, monkeypatch):
    calls, counted = [], np.bincount
    monkeypatch.setattr(em, "MAX_CELLS", 50)
    monkeypatch.setattr(em.np, "bincount", lambda x, **o: calls.append(len(x)) or counted(x, **o))
    lists = [[i % 4] * (i % 60) for i in range(200)] + [None, []]
    got = em.bucket_histogram(4).func(pa.array(lists, pa.list_(pa.float64()))).to_pylist()
    unit = lambda x: [float(v == x[0]) for v in range(4)] if x else [0.0] * 4
    assert got == [None if x is None else unit(x) for x in lists]
    assert max(calls) < 60 and len(calls) > 100
