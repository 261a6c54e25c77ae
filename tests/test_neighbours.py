"""The angular index against all pairs, and how little of them it looks at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.operators import neighbours as nb
from notemill.operators import routing as rt


def _frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "note_id int, vector array<double>").repartition(3)


def _wanted(vectors, k, least):
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    scores = np.round(unit @ unit.T, 12)
    np.fill_diagonal(scores, -np.inf)
    out = set()
    for i, row in enumerate(scores):
        best = sorted(np.flatnonzero(row >= least), key=lambda j: (-row[j], j))[:k]
        out |= {(i, int(j), r) for r, j in enumerate(best, 1)}
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16))
    return np.vstack([c + 0.05 * rng.normal(size=(50, 16)) for c in centers])


@pytest.mark.parametrize("least, k, rows, pivots", [(0.9, 3, 40, 1024), (0.5, 2, 25, 4), (0.999, 5, 7, 1), (0.01, 1, 60, 30), (0.9, 3, 4096, 1024)])
def test_same_rows_as_all_pairs(spark, clustered, least, k, rows, pivots):
    vectors = np.vstack([clustered, np.zeros((2, 16)), -clustered[:3], clustered[:1] * 3 + 1e-9])
    got = nb.nearest_at_least(_frame(spark, vectors), k, least, "note_id", block_rows=rows, max_pivots=pivots)
    assert {(r["note_id"], r["match_note_id"], r["rank"]) for r in got.collect()} == _wanted(vectors, k, least)


def test_far_blocks_are_left_out(spark, clustered):
    """Vectors meet the blocks of their own cluster, however many clusters there are."""
    counted = []
    for clusters in (3, 6, 12):
        frame = _frame(spark, clustered[:50 * clusters]).withColumnRenamed("note_id", "id")
        pivots = nb.choose_pivots(frame, "id", 2 * clusters)
        rows = nb.cut_into_rings(frame.withColumn("vector", rt.vx.unit(F.col("vector"))), "id", pivots, 20)
        rings = nb.rings_of(rows, pivots)
        own = nb.match_own_block(rows, "id", 2, 0.9)
        counted.append(nb.reach(own, "id", rings, 2, 0.9).count())
        assert len(rings.block) >= 2 * clusters
        assert counted[-1] < 0.6 * 50 * clusters * len(rings.block)
    assert counted[2] < 6 * counted[0]   # all pairs would be sixteen times as many


def test_what_is_found_narrows_the_search(spark, clustered):
    frame = _frame(spark, clustered).withColumnRenamed("note_id", "id")
    pivots = nb.choose_pivots(frame, "id", 24)
    rows = nb.cut_into_rings(frame.withColumn("vector", rt.vx.unit(F.col("vector"))), "id", pivots, 20)
    rings = nb.rings_of(rows, pivots)
    own = nb.match_own_block(rows, "id", 1, 0.2)
    known = nb.reach(own, "id", rings, 1, 0.2).count()
    unknown = nb.reach(own.withColumn("matches", F.slice("matches", 1, 0)), "id", rings, 1, 0.2).count()
    assert known < unknown


def test_selection_keeps_ties_in_column_order():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(0, 5, (6, 40)).astype(float)
        k = int(rng.integers(1, 12))
        assert (rt.best_columns(scores, k) == np.argsort(-scores, axis=1, kind="stable")[:, :k]).all()


def test_empty_and_refused(spark):
    none = spark.createDataFrame([], "note_id int, vector array<double>")
    assert nb.nearest_at_least(none, 1, 0.5, "note_id").collect() == []
    assert rt.nearest_notes(none, 1, 0.5).collect() == []
    with pytest.raises(ValueError):
        nb.nearest_at_least(none, 1, 0.0, "note_id")


def test_a_vector_goes_to_a_tile_once(spark, monkeypatch):
    """Where no angle leaves anything out, a vector is sent to each tile, not to each of its small blocks."""
    vectors = np.random.default_rng(3).normal(size=(400, 6))
    monkeypatch.setattr(nb, "TILE_ROWS", 100)
    got = nb.nearest_at_least(_frame(spark, vectors), 2, 0.01, "note_id", block_rows=10)
    assert {(r["note_id"], r["match_note_id"], r["rank"]) for r in got.collect()} == _wanted(vectors, 2, 0.01)
    frame = _frame(spark, vectors).withColumnRenamed("note_id", "id")
    pivots = nb.choose_pivots(frame, "id", 40)
    rows = nb.cut_into_rings(frame.withColumn("vector", rt.vx.unit(F.col("vector"))), "id", pivots, 10)
    rings = nb.rings_of(rows, pivots, tile_rows=100)
    own = nb.match_own_block(rows, "id", 2, 0.01)
    tiles = rings.tile.max() + 1
    assert len(rings.block) > 10 * tiles / 2 and tiles <= 8
    assert nb.reach(own, "id", rings, 2, 0.01).count() <= 400 * tiles
