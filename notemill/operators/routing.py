"""Exact top-k routing of note vectors to tag vectors, and searches among notes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notemill.functions import vectors as vx
from notemill.functions.scoring import confidence
from notemill.operators.ordering import distributed_index
from notemill.runtime import BROADCAST_MAX_BYTES, broadcast_if_small, cut_lineage

ROUTED_BY = "exact-topk-v1"
ROUTE_VERSION = 1
DEFAULT_TOP_K = 3
MAX_SCORES = 4_000_000  # similarities that a task holds at once
_CANDIDATES = "array<struct<tag:string,similarity:double,threshold:double>>"


@dataclass(frozen=True)
class TagIndex:
    """Unit tag vectors ``(tag_pos, tag, vector, threshold)``, written once, with their size."""

    table: DataFrame
    n_tags: int
    dimension: int

    @property
    def n_bytes(self) -> int:
        return self.n_tags * self.dimension * 8


def build_index(tags: DataFrame, vector: str = "vector", threshold: str | None = "confidence_threshold",
                order_by: str | None = None) -> TagIndex:
    """Normalise the tag vectors and fix their order: by ``order_by``, else by the ontology's
    ``position``, else by name. Ties in similarity go to the earlier tag.

    The table is checkpointed, so the vectors (often an aggregate over a fact
    table) are computed once and their number is known before any plan is made.
    """
    limit = F.col(threshold) if threshold else F.lit(0.5)
    order = order_by or ("position" if "position" in tags.columns else "tag")
    units = tags.select(
        F.col(order).alias("_order"), F.col("tag").cast("string").alias("tag"),
        vx.unit(vx.as_double(F.col(vector))).alias("vector"), limit.cast("double").alias("threshold"))
    # sorted by range and written once; no task sees all tags
    table = distributed_index(units, ["_order", "tag"], "tag_pos").select("tag_pos", "tag", "vector", "threshold")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    return TagIndex(table, size["n"], size["d"] or vx.FALLBACK_DIM)


def index_statistics(index: TagIndex) -> DataFrame:
    return index.table.agg(
        F.count(F.lit(1)).alias("num_tags"),
        F.coalesce(F.max(F.size("vector")), F.lit(vx.FALLBACK_DIM)).alias("embedding_dimension"),
        F.lit("exact inner product").alias("index_type"),
        F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"),
    )


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix; NULL rows become zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = int(sizes.max()) if len(sizes) else 0
    if not np.all((sizes == dim) | (sizes == 0)):
        raise ValueError("vectors of one column must have one length")
    matrix = np.zeros((len(sizes), dim))
    if dim:
        matrix[sizes > 0] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return matrix


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of unit rows, rounded so that equal similarities are equal numbers and ties go by position."""
    return np.round(left @ right.T, 12)


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores of each row, ties in column order.

    Selects first and sorts the k alone; only rows where a tie crosses the k-th place are sorted in full.
    """
    width = scores.shape[1]
    if k <= 0 or 4 * k >= width:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    picked = np.sort(np.argpartition(-scores, k - 1, axis=1)[:, :k], axis=1)
    values = np.take_along_axis(scores, picked, 1)
    last = values.min(1)[:, None]
    crossed = np.flatnonzero((scores >= last).sum(1) > k)
    if len(crossed):
        picked[crossed] = np.sort(np.argsort(-scores[crossed], axis=1, kind="stable")[:, :k], axis=1)
        values[crossed] = np.take_along_axis(scores[crossed], picked[crossed], 1)
    return np.take_along_axis(picked, np.argsort(-values, axis=1, kind="stable"), 1)


def top_candidates(vector: Column, index: TagIndex, top_k: int) -> Column:
    """Array of the best tags of a vector: one matrix product per Arrow batch.

    Only for an index under the broadcast bound; ``route`` checks it.
    """
    rows = index.table.orderBy("tag_pos").collect()  # bounded by BROADCAST_MAX_BYTES
    names = np.array([r["tag"] for r in rows], dtype=object)
    thresholds = np.array([r["threshold"] for r in rows])
    shared = vector_broadcast(index, rows)
    k = min(top_k, len(rows))

    @F.arrow_udf(_CANDIDATES)
    def candidates(batch: pa.Array) -> pa.Array:
        notes = unit_rows(matrix_of(batch))
        step = max(1, MAX_SCORES // len(names))  # rows whose scores are held at once
        best, sims = np.zeros((len(notes), k), np.int64), np.zeros((len(notes), k))
        for a in range(0, len(notes), step):
            part = notes[a:a + step]
            scores = cosines(part, shared.value) if notes.shape[1] else np.zeros((len(part), len(names)))
            best[a:a + step] = best_columns(scores, k)
            sims[a:a + step] = np.take_along_axis(scores, best[a:a + step], 1)
        flat = best.ravel()
        items = pa.StructArray.from_arrays(
            [pa.array(names[flat], pa.string()),
             pa.array(sims.ravel()),
             pa.array(thresholds[flat])],
            names=["tag", "similarity", "threshold"],
        )
        offsets = pa.array(np.arange(len(notes) + 1, dtype="int32") * k)
        return pa.ListArray.from_arrays(offsets, items, mask=batch.is_null())

    return candidates(vector)


def route_by_fold(notes: DataFrame, fold_tags: DataFrame, fold: str = "fold", vector: str = "vector",
                  threshold: float = 0.5, max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Adds the best tag of each note among the tag vectors of its own fold, in one pass over all folds.

    ``fold_tags`` has (fold, tag, vector): a few sets of tag vectors, whose size is checked.
    Rows without a vector, or of a fold without tags, get the tag ``error``.
    """
    tags = cut_lineage(fold_tags.select(fold, F.col("tag").cast("string").alias("tag"), vx.unit(vx.as_double(F.col("vector"))).alias("vector")))
    size = tags.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0))).first()[0]
    if size > max_broadcast_bytes:
        raise ValueError("the tag vectors of all folds exceed the broadcast bound")
    sets: dict = {}
    for r in tags.orderBy(fold, "tag").collect():
        sets.setdefault(r[fold], ([], []))
        sets[r[fold]][0].append(r["tag"])
        sets[r[fold]][1].append(r["vector"])
    shared = notes.sparkSession.sparkContext.broadcast(
        {f: (np.array(names, dtype=object), np.array(rows)) for f, (names, rows) in sets.items()})

    @F.arrow_udf("struct<tag:string,similarity:double>")
    def best(batch: pa.Array, folds: pa.Array) -> pa.Array:
        unit, of = unit_rows(matrix_of(batch)), np.array(folds.to_pylist(), dtype=object)
        names, sims, found = np.full(len(unit), None, dtype=object), np.zeros(len(unit)), np.zeros(len(unit), bool)
        usable = ~batch.is_null().to_numpy(zero_copy_only=False)
        for f, (tag_names, matrix) in shared.value.items():
            rows = np.flatnonzero((of == f) & usable)
            step = max(1, MAX_SCORES // len(tag_names))
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                scores = cosines(unit[part], matrix)
                top = scores.argmax(1)   # ties: the first tag
                names[part], sims[part], found[part] = tag_names[top], scores[np.arange(len(part)), top], True
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sims, mask=~found)], ["tag", "similarity"])

    routed = notes.withColumn("_best", best(F.col(vector), F.col(fold)))
    return (routed.withColumn("routed_tag", F.coalesce("_best.tag", F.lit("error")))
            .withColumn("similarity_score", F.coalesce("_best.similarity", F.lit(0.0)))
            .withColumn("confidence", F.coalesce(confidence(F.col("_best.similarity"), F.lit(threshold)), F.lit(0.0)))
            .drop("_best"))


def vector_broadcast(index: TagIndex, rows: list):
    matrix = np.array([r["vector"] for r in rows], dtype="float64")
    return index.table.sparkSession.sparkContext.broadcast(matrix)


def blocked_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, k: int,
                       min_similarity: float | None = None, skip_same_id: bool = False,
                       block_rows: int = 4096) -> DataFrame:
    """Exact top-k of every left vector among all right vectors, both sides of any size.

    Both sides need (id, vector). Each is cut by a hash of its unique id into
    blocks of about ``block_rows``; every pair of blocks is one bounded group, whose
    matrix product keeps only the k best per left row. Nothing is broadcast and
    no pair below the k best leaves a task. Work is rows x rows by nature.
    """
    spark = left.sparkSession
    n_left, n_right = left.count(), right.count()
    lb, rb = max(1, -(-n_left // block_rows)), max(1, -(-n_right // block_rows))
    l_type = left.schema[left_id].dataType.simpleString()
    r_type = right.schema[right_id].dataType.simpleString()
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lefts = left.select(F.col(left_id).alias("lid"), F.col("vector").alias("lv"),
                        block(F.col(left_id), lb).alias("i"), every(rb).alias("j"))
    rights = right.select(F.col(right_id).alias("rid"), F.col("vector").alias("rv"),
                          block(F.col(right_id), rb).alias("j"), every(lb).alias("i"))

    def score(ls: pa.Table, rs: pa.Table) -> pa.Table:
        lid, rid = ls.column("lid").combine_chunks(), rs.column("rid").combine_chunks()
        if not len(lid) or not len(rid):
            return pa.table({"lid": lid.slice(0, 0), "rid": rid.slice(0, 0), "similarity": pa.array([], pa.float64())})
        scores = cosines(unit_rows(matrix_of(ls.column("lv").combine_chunks())),
                          unit_rows(matrix_of(rs.column("rv").combine_chunks())))
        if skip_same_id:
            same = np.asarray(lid)[:, None] == np.asarray(rid)[None, :]
            scores[same] = -np.inf
        order = np.argsort(np.asarray(rid), kind="stable")  # ties: smaller right id first
        best = order[best_columns(scores[:, order], min(k, len(rid)))]
        sims = np.take_along_axis(scores, best, 1).ravel()
        keep = sims > -np.inf if min_similarity is None else sims >= min_similarity
        rows = np.repeat(np.arange(len(lid)), best.shape[1])[keep]
        return pa.table({"lid": lid.take(pa.array(rows)), "rid": rid.take(pa.array(best.ravel()[keep])),
                         "similarity": pa.array(sims[keep])})

    per_pair = (
        lefts.groupBy("i", "j").cogroup(rights.groupBy("i", "j"))
        .applyInArrow(score, f"lid {l_type}, rid {r_type}, similarity double")
    )
    # at most k rows per block remain for each left row
    rank = F.row_number().over(W.partitionBy("lid").orderBy(F.desc("similarity"), "rid"))
    return per_pair.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("lid").alias(left_id), F.col("rid").alias(f"match_{right_id}"), "similarity", "rank")


def route(notes: DataFrame, index: TagIndex, vector: str = "vector", note_id: str = "note_id",
          top_k: int = DEFAULT_TOP_K, confidence_threshold: float | None = None,
          max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Add routed tag, similarity, confidence and the top-k candidates to every note.

    With an index under the bound this is a narrow projection that also works
    on streams; a larger index is matched block by block. Rows without a vector
    get the tag ``error``. ``top_k`` is clipped to the number of tags.
    ``confidence_threshold`` adds an ``accepted`` flag and filters nothing.
    """
    if index.n_tags == 0:
        raise ValueError("the tag index is empty")
    if index.n_bytes <= max_broadcast_bytes:
        scored = notes.withColumn("candidates", top_candidates(F.col(vector), index, top_k))
    else:
        scored = _route_blocked(notes, index, vector, note_id, top_k)
    best = F.get("candidates", F.lit(0))
    routed = (
        scored.withColumn("routed_tag", F.coalesce(best["tag"], F.lit("error")))
        .withColumn("similarity_score", F.coalesce(best["similarity"], F.lit(0.0)))
        .withColumn("confidence", F.coalesce(confidence(best["similarity"], best["threshold"]), F.lit(0.0)))
        .withColumn("top_k_candidates", F.transform("candidates", lambda c: F.struct(
            c["tag"].alias("tag"), c["similarity"].alias("similarity"))))
        .drop("candidates")
    )
    if confidence_threshold is not None:
        routed = routed.withColumn("accepted", F.col("confidence") >= confidence_threshold)
    return routed


def _route_blocked(notes: DataFrame, index: TagIndex, vector: str, note_id: str, top_k: int) -> DataFrame:
    """Candidates depend on the vector alone: distinct vectors are matched under a 128-bit digest, and notes
    take theirs by it. Whole notes are shuffled once; copies of a vector are matched once."""
    key = ["_v1", "_v2"]
    digest = {"_v1": F.xxhash64(vector), "_v2": F.xxhash64(F.lit(1), vector)}
    keyed = notes.withColumns({k: F.when(F.col(vector).isNotNull(), c) for k, c in digest.items()})
    lefts = (keyed.filter(F.col(vector).isNotNull()).select(*key, F.col(vector).alias("vector")).dropDuplicates(key)
             .select(F.concat_ws(":", *key).alias("_row"), "vector"))
    matched = blocked_candidates(cut_lineage(lefts), index.table, "_row", "tag_pos", top_k)
    named = matched.join(index.table.select(F.col("tag_pos").alias("match_tag_pos"), "tag", "threshold"),
                         "match_tag_pos")
    # at most top_k entries per vector
    packed = named.groupBy("_row").agg(F.array_sort(F.collect_list(
        F.struct("rank", "tag", "similarity", "threshold"))).alias("_c"))
    picked = packed.select("_row", F.transform("_c", lambda c: F.struct(
        c["tag"].alias("tag"), c["similarity"].alias("similarity"), c["threshold"].alias("threshold")
    )).alias("candidates"))
    return keyed.withColumn("_row", F.when(F.col("_v1").isNotNull(), F.concat_ws(":", *key))).join(
        picked, "_row", "left").drop("_row", *key)


def with_result_columns(routed: DataFrame, tags: DataFrame, model: str = "hashed-tokens") -> DataFrame:
    """The full result row: tag description and examples, provenance and metadata."""
    details = tags.select(F.col("tag").alias("routed_tag"), F.col("description").alias("tag_description"),
                          F.col("examples").alias("tag_examples"))
    return (
        routed.join(broadcast_if_small(details), "routed_tag", "left")
        .withColumn("routed_by", F.lit(ROUTED_BY))
        .withColumn("version", F.lit(ROUTE_VERSION))
        .withColumn("metadata", F.struct(
            F.lit(model).alias("embedding_model"),
            F.lit(False).alias("disambiguation_used"),
            F.col("top_k_candidates").alias("top_k_candidates"),
        ))
        .drop("top_k_candidates")
    )


def split_routes(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    failed = F.col("routed_tag") == "error"
    return routed.filter(~failed), routed.filter(failed)


def similarities_to(df: DataFrame, query: DataFrame, vector: str = "vector", out: str = "similarity") -> DataFrame:
    """Cosine of every vector with the one vector that ``query`` returns."""
    return df.withColumn("_q", query.scalar()).withColumn(
        out, vx.cosine(vx.as_double(F.col(vector)), vx.as_double(F.col("_q")))).drop("_q")


def similarity_search(notes: DataFrame, queries: DataFrame, k: int, min_similarity: float,
                      note_id: str = "note_id", query_id: str = "query_id",
                      max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """The k most similar notes of every query vector at or above ``min_similarity``.

    Query vectors under the bound travel to the notes, which stay where they
    are: each batch gives at most k notes per query, ranked again per query. More queries
    than that are matched block by block.
    """
    notes = notes.filter(F.col("vector").isNotNull())
    queries = cut_lineage(queries.select(query_id, vx.as_double(F.col("vector")).alias("vector")))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 > max_broadcast_bytes:
        return blocked_candidates(queries, notes, query_id, note_id, k, min_similarity)
    rows = queries.collect()  # bounded above
    if not rows:
        return blocked_candidates(queries, notes, query_id, note_id, k, min_similarity)
    q_type = queries.schema[query_id].dataType.simpleString()
    n_type = notes.schema[note_id].dataType.simpleString()
    ids = pa.array([r[query_id] for r in rows])
    shared = notes.sparkSession.sparkContext.broadcast(np.array([r["vector"] for r in rows], dtype="float64"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_queries = unit_rows(shared.value)
        step = max(1, MAX_SCORES // len(unit_queries))   # notes whose scores are held at once
        for whole in batches:
            whole = whole.sort_by(whole.schema.names[0])  # ties: smaller note id first
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                scores = cosines(unit_queries, unit_rows(matrix_of(batch.column(1))))
                best = best_columns(scores, k)
                sims = np.take_along_axis(scores, best, 1).ravel()
                keep = sims >= min_similarity
                which = np.repeat(np.arange(len(ids)), best.shape[1])[keep]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which)), batch.column(0).take(pa.array(best.ravel()[keep])), pa.array(sims[keep])],
                    names=["q", "n", "similarity"])

    slim = notes.select(note_id, "vector")
    found = slim.mapInArrow(search, f"q {q_type}, n {n_type}, similarity double")
    # the rank limit is applied before the shuffle too, so a query moves k rows per partition
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("similarity"), "n"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        F.col("q").alias(query_id), F.col("n").alias(f"match_{note_id}"), "similarity", "rank")


def nearest_notes(notes: DataFrame, k: int = 1, min_similarity: float = 0.8,
                  note_id: str = "note_id", block_rows: int = 4096) -> DataFrame:
    """For every distinct vector its k most similar other ones at cosine >= ``min_similarity``.

    Exact copies are first merged into the smallest id with a count, so a group
    of copies is one row and never makes pairs with itself. Above a similarity of 0 the
    angular index leaves out blocks that are too far away; else all blocks meet.
    """
    from notemill.operators.neighbours import nearest_at_least

    distinct = notes.filter(F.col("vector").isNotNull()).groupBy("vector").agg(
        F.min(note_id).alias(note_id), F.count(F.lit(1)).alias("copies"))
    distinct = cut_lineage(distinct)
    if min_similarity > 0:
        matched = nearest_at_least(distinct, k, min_similarity, note_id, block_rows)
    else:
        matched = blocked_candidates(distinct, distinct, note_id, note_id, k, min_similarity, skip_same_id=True,
                                     block_rows=block_rows)
    return distinct.select(note_id, "copies").join(matched, note_id)


def vote(results: Column) -> Column:
    """Majority vote over an array of (tag, similarity): struct of routed_tag, votes, mean_similarity.

    Ties go to the larger mean similarity, then the tag name. It is worked out inside the row.
    """
    def standing(tag: Column) -> Column:
        own = F.filter(results, lambda r: r["tag"] == tag)
        total = F.aggregate(own, F.lit(0.0), lambda s, r: s + r["similarity"])
        mean = total / F.size(own)
        return F.struct((-F.size(own)).alias("a"), (-mean).alias("b"), tag.alias("routed_tag"),
                        F.size(own).cast("long").alias("votes"), mean.alias("mean_similarity"))

    return F.array_min(F.transform(F.array_distinct(F.transform(results, lambda r: r["tag"])), standing))


def ensemble_route(notes: DataFrame, routers: dict[str, tuple[Column, TagIndex]]) -> DataFrame:
    """Adds routed_tag, votes and mean_similarity of several routers (vector and index each) of a note.

    All routers run in one pass over the notes; nothing is shuffled. A router without a
    vector for a note votes ``error`` with similarity 0.
    """
    for name, (_, index) in routers.items():
        if index.n_bytes > BROADCAST_MAX_BYTES:
            raise ValueError(f"the index of router {name} exceeds the broadcast bound")
    best = [F.get(top_candidates(vector, index, 1), F.lit(0)) for vector, index in routers.values()]
    cast = F.array(*[F.struct(F.coalesce(b["tag"], F.lit("error")).alias("tag"),
                              F.coalesce(b["similarity"], F.lit(0.0)).alias("similarity")) for b in best])
    voted = notes.withColumn("_votes", cast).withColumn("_winner", vote(F.col("_votes")))
    return voted.select(*notes.columns, "_winner.routed_tag", "_winner.votes", "_winner.mean_similarity")


def ensemble_vote(results: list[DataFrame], note_id: str = "note_id") -> DataFrame:
    """The same vote over results that exist as tables, one per router; joined by note and voted in the row."""
    slim = [r.select(note_id, F.struct(F.col("routed_tag").alias("tag"), F.col("similarity_score").alias("similarity")).alias(f"_r{i}"))
            for i, r in enumerate(results)]
    joined = slim[0]
    for other in slim[1:]:
        joined = joined.join(other, note_id, "full")
    cast = F.array_compact(F.array(*[f"_r{i}" for i in range(len(slim))]))
    winner = joined.select(note_id, vote(cast).alias("_w"))
    return winner.select(note_id, "_w.routed_tag", "_w.votes", "_w.mean_similarity")
