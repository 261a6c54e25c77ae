"""Embedding and routing against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.functions import vectors as vx
from notemill.operators import embedding as em
from notemill.operators import routing as rt
from notemill.sources import ontology as on

DIM = 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    return rng.normal(size=(60, DIM)), rng.normal(size=(7, DIM))


def _notes(spark, matrix):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "note_id int, vector array<double>")


def _tags(spark, matrix):
    return spark.createDataFrame([(f"t{i}", v.tolist(), 0.3) for i, v in enumerate(matrix)],
                                 "tag string, vector array<double>, confidence_threshold double")


def _unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_top_k_matches_numpy(spark, data):
    notes, tags = data
    scores = _unit(notes) @ _unit(tags).T
    want = np.argsort(-scores, axis=1)[:, :3]
    index = rt.build_index(_tags(spark, tags))
    for bound in (10 ** 9, 0):
        routed = rt.route(_notes(spark, notes), index, max_broadcast_bytes=bound).orderBy("note_id").collect()
        assert len(routed) == len(notes)
        for i, row in enumerate(routed):
            assert [c["tag"] for c in row["top_k_candidates"]] == [f"t{j}" for j in want[i]]
            assert row["similarity_score"] == pytest.approx(scores[i].max())


def test_edges(spark, data):
    _, tags = data
    index = rt.build_index(_tags(spark, tags))
    notes = spark.createDataFrame([(0, [0.0] * DIM), (1, None), (2, tags[2].tolist())],
                                  "note_id int, vector array<double>")
    for bound in (10 ** 9, 0):
        zero, none, same = rt.route(notes, index, top_k=50, max_broadcast_bytes=bound).orderBy("note_id").collect()
        assert zero["routed_tag"] == "t0" and zero["similarity_score"] == 0.0
        assert none["routed_tag"] == "error" and none["confidence"] == 0.0
        assert same["routed_tag"] == "t2" and same["confidence"] == pytest.approx(1.0)
        assert len(same["top_k_candidates"]) == 7
    with pytest.raises(ValueError):
        rt.route(notes, rt.build_index(_tags(spark, tags).limit(0)))


def test_blocks_of_every_size_agree(spark, data):
    notes, tags = data
    left = _notes(spark, notes)
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(tags)], "tid int, vector array<double>")
    results = []
    for rows in (3, 11, 1000):
        out = rt.blocked_candidates(left, right, "note_id", "tid", 2, block_rows=rows)
        results.append(sorted((r["note_id"], r["rank"], r["match_tid"]) for r in out.collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == 2 * len(notes)


def test_search_and_copies(spark, data):
    notes, _ = data
    many = np.vstack([notes] + [notes[:1]] * 40)  # a hot group of copies
    df = _notes(spark, many)
    near = rt.nearest_notes(df, 1, -1.0).collect()
    assert len(near) == len(notes)
    assert {r["copies"] for r in near if r["note_id"] == 0} == {41}
    scores = _unit(notes) @ _unit(notes).T
    np.fill_diagonal(scores, -np.inf)
    for r in near:
        assert r["match_note_id"] == int(scores[r["note_id"]].argmax())
    queries = spark.createDataFrame([("q", notes[5].tolist())], "query_id string, vector array<double>")
    for bound in (10 ** 9, 0):
        hits = rt.similarity_search(df, queries, 3, 0.1, max_broadcast_bytes=bound).orderBy("rank").collect()
        assert hits[0]["match_note_id"] == 5 and hits[0]["similarity"] == pytest.approx(1.0)
        assert [h["similarity"] for h in hits] == sorted((h["similarity"] for h in hits), reverse=True)


def test_cosine_and_normalisations(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([2.0, 2.0], [2.0, 2.0])]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(
        vx.cosine(a, b).alias("c"), vx.unit(a).alias("u"), vx.min_max(a).alias("m"), vx.z_score(a).alias("z"),
        vx.vector_issue(a).alias("i")).collect()
    assert [r["c"] for r in got] == pytest.approx([0.96, 0.0, 1.0])
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[1]["u"] == [0.0, 0.0]
    assert got[0]["m"] == [0.0, 1.0] and got[2]["m"] == [0.0, 0.0]
    assert got[0]["z"] == pytest.approx([-1.0, 1.0]) and got[2]["z"] == [0.0, 0.0]
    assert [r["i"] for r in got] == ["not_unit", "zero", "not_unit"]


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("a b",), ("b  a",), ("",), (None,), ("c d e f",)], "text string")
    v = [r["vector"] for r in em.embed_hashed(df, dim=32).collect()]
    assert v[0] == v[1] and sum(v[2]) == 0 and v[3] is None and len(v[0]) == 32
    assert np.linalg.norm(v[0]) == pytest.approx(1.0)
    assert np.dot(v[0], v[4]) < 0.9


def test_tag_vectors(spark):
    tags = on.default_tags(spark).unionByName(spark.createDataFrame(
        [("empty", "no examples here", [], 0.5, None)], on.TAG_SCHEMA))
    embed = lambda d: em.embed_hashed(d, dim=16)
    means = {r["tag"]: r["vector"] for r in em.tag_example_vectors(tags, embed, 16).collect()}
    assert means["empty"] == [0.0] * 16 and len(means) == 9
    both = {r["tag"]: r["vector"] for r in em.tag_definition_vectors(tags, embed).collect()}
    alone = {r["tag"]: r["vector"] for r in em.tag_description_vectors(tags, embed).collect()}
    assert both["todo_item"] != alone["todo_item"] and both["empty"] == pytest.approx(alone["empty"])


def test_user_model_is_called_once_per_distinct_text(spark):
    def load():
        def model(texts):
            assert len(set(texts)) == len(texts)
            return np.array([[len(t), 1.0] for t in texts])
        return model

    df = spark.createDataFrame([("aa",), ("b",), ("aa",), (None,)], "text string").coalesce(1)
    got = [r["vector"] for r in em.embed_with_model(df, load).collect()]
    assert got == [[2.0, 1.0], [1.0, 1.0], [2.0, 1.0], None]
    joined = em.embed_distinct(df, lambda d: em.embed_with_model(d, load)).collect()
    assert len(joined) == 4


def test_ensemble_and_results(spark):
    votes = [[("a", 0.9)], [("b", 0.5)], [("b", 0.4)]]
    frames = [spark.createDataFrame([(1, t, s) for t, s in v], "note_id int, routed_tag string, similarity_score double")
              for v in votes]
    assert rt.ensemble_vote(frames).first()["routed_tag"] == "b"
    assert rt.ensemble_vote(frames[:2]).first()["routed_tag"] == "a"
