"""Exact nearest notes at a least similarity, by pivots with angular radii.

The angle between unit vectors is a metric. Every vector belongs to the pivot it is closest
to; the vectors of a pivot are cut into blocks by their angle to it, so that a block is a ring
(pivot, least angle, greatest angle). By the triangle inequality a vector at angle t to
a block's pivot is at least max(t - greatest, least - t) away from all of the block. Blocks
whose least angle exceeds that of the wanted similarity are never met. Blocks are first matched
with themselves; a vector's k-th best similarity from there narrows what it has to meet.

On clustered vectors each one meets the few blocks around it. Where all angles are about equal
nothing can be left out, and the work is that of all pairs of blocks.

Blocks of close pivots are packed into tiles of bounded bytes. A vector is sent to each tile that holds
a block it has to meet, once however small the blocks are, and two tiles meet in one bounded group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notemill.functions import vectors as vx
from notemill.operators.routing import best_columns, cosines, matrix_of, unit_rows
from notemill.runtime import broadcast_if_small, cut_lineage

MAX_PIVOTS = 1024
MAX_BLOCKS = 500_000     # their rings are known to every task
SAMPLE_BYTES = 64 << 20  # of vectors that the pivots are chosen from
BINS = 1024              # steps of the angle to a pivot
SLACK = 4e-6             # above the error of an angle from a rounded cosine
MAX_SCORES = 1 << 20     # similarities or angles that a task holds at once
TILE_ROWS = 16_384       # vectors of a tile, at most, unless a block has more
TILE_BYTES = 16 << 20    # of a tile's vectors


@dataclass(frozen=True)
class Rings:
    """What every task knows of the blocks, one entry a block."""

    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    tile: np.ndarray


def choose_pivots(units: DataFrame, id_col: str, n: int) -> np.ndarray:
    """``n`` vectors far from each other, from a bounded sample by a hash of the id."""
    dim = len(units.first()["vector"])
    size = max(n, min(8 * n, SAMPLE_BYTES // (8 * dim)))
    rows = units.orderBy(F.xxhash64(id_col), id_col).limit(size).select("vector").collect()
    sample = unit_rows(np.array([r["vector"] for r in rows]))
    chosen, closest = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
    return sample[chosen]


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def cut_into_rings(units: DataFrame, id_col: str, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """(id, vector, pivot, angle, block): blocks hold about ``block_rows`` vectors of one ring of one pivot."""
    shared = units.sparkSession.sparkContext.broadcast(pivots)
    id_type = units.schema[id_col].dataType.simpleString()

    def place(batches):
        for batch in batches:
            vectors = matrix_of(batch.column("vector"))
            step = max(1, MAX_SCORES // len(shared.value))
            pivot, angle = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for a in range(0, len(vectors), step):
                far = _angles(vectors[a:a + step], shared.value)
                pivot[a:a + step] = far.argmin(1)
                angle[a:a + step] = far.min(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("vector"), pa.array(pivot), pa.array(angle),
                 pa.array((angle * (BINS / np.pi)).astype(np.int32))], [id_col, "vector", "pivot", "angle", "bin"])

    placed = cut_lineage(units.select(id_col, "vector").mapInArrow(
        place, f"`{id_col}` {id_type}, vector array<double>, pivot int, angle double, bin int"))
    # at most pivots x BINS rows
    before = F.sum("n").over(W.partitionBy("pivot").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    bins = placed.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n")).select(
        "pivot", "bin", F.floor(F.coalesce(before, F.lit(0)) / block_rows).alias("ring"),
        F.ceil(F.col("n") / block_rows).alias("parts"))
    # a bin of many vectors is cut by hash as well
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(id_col), F.col("parts"))).otherwise(F.lit(0))
    block = (F.shiftleft(F.col("pivot").cast("bigint"), 44) + F.shiftleft(F.col("ring").cast("bigint"), 24) + part)
    return cut_lineage(placed.join(broadcast_if_small(bins), ["pivot", "bin"]).select(
        id_col, "vector", "pivot", "angle", block.alias("block")))


def _in_a_row(pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot in a walk that goes on to the closest one left."""
    place, at, left = np.zeros(len(pivots), np.int64), 0, np.ones(len(pivots), bool)
    for step in range(len(pivots)):
        place[at], left[at] = step, False
        at = int(np.where(left, pivots @ pivots[at], -np.inf).argmax())
    return place


def rings_of(rows: DataFrame, pivots: np.ndarray, tile_rows: int = 1) -> Rings:
    """The blocks of ``rows``; those of close pivots are packed into tiles of about ``tile_rows`` vectors."""
    found = rows.groupBy("block").agg(F.min("pivot").alias("pivot"), F.min("angle").alias("lo"),
                                      F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # bounded by MAX_BLOCKS
    column = lambda name, kind: np.array([r[name] for r in found], kind)
    block, pivot, lo, hi, n = (column(c, t) for c, t in (
        ("block", np.int64), ("pivot", np.int64), ("lo", float), ("hi", float), ("n", np.int64)))
    order = np.lexsort((block, _in_a_row(pivots)[pivot]))
    # a tile's blocks stand side by side
    tile, filled = np.zeros(len(order), np.int32), 0
    for i, size in enumerate(n[order].tolist()):
        new = i > 0 and filled + size > tile_rows
        tile[i] = tile[i - 1] + new if i else 0
        filled = size if new else filled + size
    return Rings(pivots, block[order], pivot[order], lo[order], hi[order], tile)


def match_own_block(rows: DataFrame, id_col: str, k: int, min_similarity: float) -> DataFrame:
    """(id, vector, block, matches): the k best of a vector's own block."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(group):
        group = group.combine_chunks().sort_by(id_col)   # ties: smaller id first
        ids, unit = group.column(id_col).combine_chunks(), matrix_of(group.column("vector").combine_chunks())
        n = len(ids)
        step = max(1, MAX_SCORES // n)
        place, sims, sizes = [], [], []
        for a in range(0, n, step):
            scores = cosines(unit[a:a + step], unit)
            scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
            best = best_columns(scores, min(k, n))
            s = np.take_along_axis(scores, best, 1)
            keep = s >= min_similarity
            place.append(best[keep])
            sims.append(s[keep])
            sizes.append(keep.sum(1))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        items = pa.StructArray.from_arrays([ids.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(sims))],
                                           ["id", "similarity"])
        return pa.table({id_col: ids, "vector": group.column("vector"), "block": group.column("block"),
                         "matches": pa.ListArray.from_arrays(pa.array(ends), items)})

    return rows.select(id_col, "vector", "block").groupBy("block").applyInArrow(
        run, f"`{id_col}` {id_type}, vector array<double>, block bigint, matches array<struct<id:{id_type},similarity:double>>")


def tiles_to_meet(rows: DataFrame, id_col: str, rings: Rings, k: int, min_similarity: float) -> DataFrame:
    """(id, vector, block, floor, tile, others): of each vector its tile and those with further blocks that it has to meet."""
    shared = rows.sparkSession.sparkContext.broadcast(rings)
    id_type = rows.schema[id_col].dataType.simpleString()
    # the k-th best so far, where there are k
    floor = F.when(F.size("matches") >= k, F.array_min(F.transform("matches", lambda m: m["similarity"])))
    source = rows.select(id_col, "vector", "block", F.coalesce(floor, F.lit(float(min_similarity))).alias("floor"))

    def run(batches):
        r = shared.value
        step = max(1, MAX_SCORES // max(len(r.block), len(r.pivots)))
        first = np.flatnonzero(np.diff(r.tile, prepend=-1))
        sorted_blocks = np.argsort(r.block)
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                own = batch.column("block").to_numpy()
                angle = _angles(matrix_of(batch.column("vector")), r.pivots)[:, r.pivot]
                nearest = np.maximum(angle - r.greatest, r.least - angle)
                limit = np.arccos(np.clip(batch.column("floor").to_numpy(), -1.0, 1.0)) + SLACK
                meets = (nearest <= limit[:, None]) & (own[:, None] != r.block)
                row, other = np.nonzero(np.logical_or.reduceat(meets, first, axis=1))
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                tile = r.tile[sorted_blocks[np.searchsorted(r.block, own, sorter=sorted_blocks)]]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(tile), pa.ListArray.from_arrays(pa.array(ends), pa.array(other.astype(np.int32)))],
                    [id_col, "vector", "block", "floor", "tile", "others"])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, vector array<double>, block bigint, floor double, tile int, others array<int>")


def reach(rows: DataFrame, id_col: str, rings: Rings, k: int, min_similarity: float) -> DataFrame:
    """(id, vector, block, floor, tile, other): a row for each further tile that a vector has to meet."""
    met = tiles_to_meet(rows, id_col, rings, k, min_similarity)
    return met.select(*met.columns[:-1], F.explode("others").alias("other"))


def _best_hits(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of at most the k largest scores of each row at or above its floor, ties in column order."""
    row, column = np.nonzero(scores >= floor[:, None] - 1e-11)
    sims = np.round(scores[row, column], 12)
    keep = sims >= floor[row]
    row, column, sims = row[keep], column[keep], sims[keep]
    order = np.lexsort((column, -sims, row))
    row, column, sims = row[order], column[order], sims[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k], sims[rank < k]


def nearest_at_least(vectors: DataFrame, k: int, min_similarity: float, id_col: str, block_rows: int = 4096,
                     max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(id, match_id, similarity, rank): for each vector its k most similar others at or above ``min_similarity``.

    ``vectors`` has unique ids and a column ``vector``; ``min_similarity`` must be above 0, so that zero
    vectors match nothing. Ties go to the smaller id.
    """
    if min_similarity <= 0:
        raise ValueError("the angular index needs a least similarity above 0")
    id_type = vectors.schema[id_col].dataType.simpleString()
    v = vx.unit(vx.as_double(F.col("vector")))
    units = cut_lineage(vectors.select(id_col, v.alias("vector")).filter(vx.norm(F.col("vector")) > 0))
    n = units.count()
    block_rows = max(block_rows, n // MAX_BLOCKS)
    if n:
        pivots = choose_pivots(units, id_col, max(1, min(max_pivots, 4 * n // block_rows)))
        rows = cut_into_rings(units, id_col, pivots, block_rows)
    else:
        rows = units.select(id_col, "vector", F.lit(0).alias("pivot"), F.lit(0.0).alias("angle"), F.lit(0).cast("bigint").alias("block"))
        pivots = np.zeros((1, 1))
    own = cut_lineage(match_own_block(rows, id_col, k, min_similarity))
    found = own.select(F.col(id_col).alias("lid"), F.explode("matches").alias("m")).select(
        "lid", F.col("m.id").alias("rid"), F.col("m.similarity").alias("similarity"))
    width = 8 * max(1, pivots.shape[1])
    rings = rings_of(rows, pivots, max(block_rows, min(TILE_ROWS, TILE_BYTES // width)))
    if len(rings.block) > 1:
        met = cut_lineage(tiles_to_meet(own, id_col, rings, k, min_similarity))
        lefts = met.select(id_col, "vector", "block", "floor", F.col("tile").alias("asks"), F.explode("others").alias("of"))
        # at most the square of the tiles
        pairs = met.select(F.col("tile").alias("asks"), F.explode("others").alias("of")).distinct()
        rights = met.select(F.col(id_col).alias("rid"), F.col("vector").alias("rv"), F.col("block").alias("rb"),
                            F.col("tile").alias("of")).join(broadcast_if_small(pairs), "of")

        def score(ls, rs):
            if not len(ls) or not len(rs):
                return pa.table({"lid": ls.column(id_col).slice(0, 0), "rid": rs.column("rid").slice(0, 0), "similarity": pa.array([], pa.float64())})
            rs = rs.sort_by("rid")   # ties: smaller id first
            rid, right = rs.column("rid").combine_chunks(), matrix_of(rs.column("rv").combine_chunks())
            lid, left = ls.column(id_col).combine_chunks(), matrix_of(ls.column("vector").combine_chunks())
            same_tile = ls.column("asks")[0].as_py() == rs.column("of")[0].as_py()
            floor, lb, rb = ls.column("floor").to_numpy(), ls.column("block").to_numpy(), rs.column("rb").to_numpy()
            step = max(1, MAX_SCORES // len(rid))
            out = []
            for a in range(0, len(lid), step):
                scores = left[a:a + step] @ right.T
                if same_tile:   # a vector's own block is done
                    scores[lb[a:a + step, None] == rb] = -np.inf
                row, col, sims = _best_hits(scores, floor[a:a + step], k)
                out.append(pa.table({"lid": lid.take(pa.array(row + a)), "rid": rid.take(pa.array(col)), "similarity": pa.array(sims)}))
            return pa.concat_tables(out)

        far = lefts.groupBy("asks", "of").cogroup(rights.groupBy("asks", "of")).applyInArrow(
            score, f"lid {id_type}, rid {id_type}, similarity double")
        found = found.unionByName(far)
    rank = F.row_number().over(W.partitionBy("lid").orderBy(F.desc("similarity"), "rid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("lid").alias(id_col), F.col("rid").alias(f"match_{id_col}"), "similarity", "rank")
