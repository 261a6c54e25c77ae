"""Row numbers and trailing frames that never put one hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notemill.runtime import broadcast_if_small, cut_lineage

# monotonically_increasing_id keeps the partition in the upper 31 bits
_ROW_BITS = 33


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on ``keys`` in which NULL meets NULL; the keys stand once in the result."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def distributed_index(df: DataFrame, order_by: list[str], pos: str = "pos") -> DataFrame:
    """Global 0-based position in ``order_by`` order.

    A range sort spreads even a single hot key over many partitions (the key
    list should end in a unique column). The sorted layout is checkpointed, so
    the per-partition counts and the row numbers come from the same rows; only
    one row per partition is windowed.
    """
    ordered = cut_lineage(df.orderBy(*order_by))
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_mid", _ROW_BITS)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per sorted partition, so the broadcast is bounded by the partition count
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(pos, F.col("_offset") + F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_part", "_mid", "_offset")
    )


def hashed_row_number(df: DataFrame, partition: str, order_key: str, id_col: str,
                      name: str = "rn", total: str | None = None, prefix_chars: int = 3) -> DataFrame:
    """1-based row number inside ``partition`` in the order of a hex digest ``order_key``.

    The digest is uniform, so its first characters cut even a hot partition
    into ``16 ** prefix_chars`` equal pieces; the pieces' counts give offsets
    and, under ``total``, the size of the partition.
    """
    pieces = df.withColumn("_piece", F.substring(order_key, 1, prefix_chars))
    sizes = pieces.groupBy(partition, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(partition).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        partition, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_n").over(W.partitionBy(partition)).alias(total)] if total else []))
    inside = W.partitionBy(partition, "_piece").orderBy(order_key, id_col)
    return (
        null_safe_join(pieces.withColumn("_inside", F.row_number().over(inside)), offsets, [partition, "_piece"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_piece", "_inside", "_offset")
    )


def round_robin(df: DataFrame, order_by: list[str], labels: list[str], name: str) -> DataFrame:
    """Assign ``labels[i % n]`` to the i-th row."""
    values = F.array(*[F.lit(x) for x in labels])
    indexed = distributed_index(df, order_by, "_pos")
    return indexed.withColumn(name, F.get(values, (F.col("_pos") % len(labels)).cast("int"))).drop("_pos")


def trailing_rows_average(df: DataFrame, key: str, order_by: list[str], value: str, n: int,
                          name: str, chunk_rows: int = 50_000) -> DataFrame:
    """Average of ``value`` over the last ``n`` rows of the same key, for every row.

    The sorted rows are cut into chunks and each chunk also receives the last
    ``n - 1`` rows of the one before it, so a hot key is spread over many tasks.
    """
    if chunk_rows < n:
        raise ValueError("chunk_rows must be at least n")
    indexed = distributed_index(df, [key, *order_by], "_pos")
    chunk = F.floor(F.col("_pos") / chunk_rows)
    tail = F.col("_pos") % chunk_rows > chunk_rows - n
    spread = indexed.withColumn(
        "_chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    frame = W.partitionBy(key, "_chunk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    return (
        spread.withColumn(name, F.avg(value).over(frame))
        .filter(F.col("_chunk") == chunk)
        .drop("_chunk", "_pos")
    )


def trailing_time_count(df: DataFrame, key: str, ts: str, window_seconds: int, name: str,
                        slices: int = 60) -> DataFrame:
    """For every row: rows of the same key with ``now - window <= ts <= now`` (both inclusive).

    Time is cut into slices of ``window / slices``. A row counts its own slice
    up to itself, the whole slices in between (from a small table of slice
    counts) and the part of the oldest slice still inside the window. Rows meet
    only the rows of their own slice and of the slice one window earlier.
    """
    span = window_seconds * 1_000_000
    slices = next(n for n in range(slices, 0, -1) if span % n == 0)  # slices fill the window exactly
    width = span // slices
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_slice", F.floor(F.col("_us") / width))
    counts = rows.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # whole slices between: s-slices+1 .. s-1
    between = W.partitionBy(key).orderBy("_slice").rangeBetween(-(slices - 1), -1)
    middle = counts.select(key, "_slice", F.coalesce(F.sum("_n").over(between), F.lit(0)).alias("_middle"))

    now = rows.withColumn("_at", F.col("_us")).withColumn("_now", F.lit(1))
    # Only the times travel a second time, counted per distinct instant.
    old = (
        rows.groupBy(key, "_us").agg(F.count(F.lit(1)).alias("_old"))
        .withColumn("_at", F.col("_us") + span)
        .withColumn("_slice", F.floor(F.col("_at") / width))
        .drop("_us")
    )
    both = now.unionByName(old, allowMissingColumns=True)
    by_slice = W.partitionBy(key, "_slice").orderBy("_at")
    upto = by_slice.rangeBetween(W.unboundedPreceding, W.currentRow)
    fromhere = by_slice.rangeBetween(W.currentRow, W.unboundedFollowing)
    counted = (
        both.withColumn("_own", F.sum(F.coalesce("_now", F.lit(0))).over(upto))
        .withColumn("_still", F.sum(F.coalesce("_old", F.lit(0))).over(fromhere))
        .filter(F.col("_now") == 1)
    )
    return (
        null_safe_join(counted, middle, [key, "_slice"])
        .withColumn(name, F.col("_own") + F.col("_still") + F.col("_middle"))
        .drop("_us", "_slice", "_at", "_now", "_old", "_own", "_still", "_middle")
    )


def exact_ranks(df: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per key, the values at 0-based ranks of the sorted list; each rank is a column over ``n``.

    Two slim columns are sorted across the cluster and the wanted rows picked
    by position; no group is ever collected.
    """
    slim = df.select(key, value).filter(F.col(value).isNotNull())
    indexed = distributed_index(slim, [key, value], "_pos")
    spans = cut_lineage(indexed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("_start")))
    wanted = spans.select(
        key, "n",
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("name"), (F.col("_start") + rank.cast("long")).alias("_pos"))
            for name, rank in ranks.items()
        ])).alias("w"),
    ).select(key, "n", "w.name", "w._pos")
    picked = broadcast_if_small(wanted).join(indexed.drop(key), "_pos")
    return picked.groupBy(key).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in ranks],
    )
