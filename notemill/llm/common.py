"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# the ASCII white space of all contracts: space and \t \n \v \f \r; bytes.split() cuts at the same six
ASCII_WS = r"\x20\x09-\x0D"
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; where it is unset, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_notemill").rstrip("/")


def spare(df: DataFrame, name: str) -> str:
    """``name``, with further underscores before it as long as a column has it already, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of bounded rows and bytes for jobs started inside, so that long texts do not fill a worker."""
    before = {key: spark.conf.get(key, None) for key in ARROW_LIMITS}
    try:
        for key, value in ARROW_LIMITS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to a fresh table of the shared folder and read it from there.

    Cuts the lineage: a lost executor costs a read of the files, not a new run
    of all that made them.
    """
    path = f"{shared_folder(df.sparkSession)}/notemill-llm-{uuid.uuid4().hex}/{name}"
    with small_batches(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
                schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df`` inside the tasks (narrow, no shuffle)."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def crc32_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_unique(rows: DataFrame, facts: DataFrame, keys: list[str], hot: Column, spread_by: list[str]) -> DataFrame:
    """``rows`` left-joined with ``facts``, which are unique by ``keys``, without a hot task.

    Facts of which ``hot`` holds are broadcast; the caller's condition bounds their number
    (at most k groups can hold more than a k-th of all rows each). Rows that found one are
    spread by the columns ``spread_by`` in the join with the other facts, whose keys they
    cannot match. Keys must not be null.
    """
    values = [c for c in facts.columns if c not in keys]
    seen, cold_part, part = (spare(rows, n) for n in ("_seen", "_cold_part", "_part"))
    names = {side: {c: spare(rows, f"_{side}_{c}") for c in facts.columns} for side in ("hot", "cold")}
    same = lambda side: reduce(lambda a, b: a & b, [F.col(k) == F.col(names[side][k]) for k in keys])
    few = facts.filter(hot).select(*[F.col(c).alias(n) for c, n in names["hot"].items()], F.lit(True).alias(seen))
    many = facts.filter(~hot).select(*[F.col(c).alias(n) for c, n in names["cold"].items()],
                                     F.xxhash64(*keys).alias(cold_part))
    step = rows.join(F.broadcast(few), same("hot"), "left").withColumn(
        part, F.when(F.col(seen), F.xxhash64(*spread_by)).otherwise(F.xxhash64(*keys)))
    step = step.join(many, (F.col(part) == F.col(cold_part)) & same("cold"), "left")
    return step.select(*[F.col(f"`{c}`") for c in rows.columns],
                       *[F.coalesce(names["hot"][c], names["cold"][c]).alias(c) for c in values])


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes, null as empty."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]
