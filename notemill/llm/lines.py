"""Line de-duplication over the whole corpus.

Lines are exploded as (document, position, 128-bit hash of the key); documents
per hash are counted after a distinct, so that a line which stands in a third of
all documents reaches the count as one row per map task. The lines to drop come
from an equi-join with the few repeated hashes, of which the very common ones are broadcast, and
go back to the documents as lists of positions.

Defined results: a null or empty text is one empty line and drops nothing (the
text stays null). Rows with the same doc_id count as one document; rows with a
null doc_id count as one document, which is never the keeper while another
holds the line. Other columns stay as they are; one with the name of a result
is replaced by it. Very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import join_unique, map_batches, spare, table

HOT = 1_000
WS_BYTES = b" \t\n\r\x0b\x0c"
_LINES = "doc_id bigint, row_hash bigint, pos int, h1 bigint, h2 bigint"


def exploded_lines(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """A row for each line whose key has ``min_chars`` code points: its row, position and key hash."""
    schema = T.StructType.fromDDL(_LINES)
    names = schema.names

    def run(batch: pa.RecordBatch):
        rows, places, digests = [], [], []
        for k, value in enumerate(batch.column(2).cast(pa.large_binary()).to_pylist()):
            for pos, line in enumerate((value or b"").lower().split(b"\n")):
                key = line.strip(WS_BYTES)
                if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                    rows.append(k)
                    places.append(pos)
                    digests.append(xxhash.xxh3_128_digest(key))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()),
            pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))], names)

    return map_batches(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                                   F.xxhash64(text).alias("row_hash"), text), run, schema)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 20,
                min_docs: int = 3, kept: str = "kept_text") -> DataFrame:
    """Adds ``kept`` (the text without dropped lines), ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points in at least ``min_docs``
    documents keeps its lines only in the largest doc_id that holds it.
    """
    drop_id, drop_hash, drop, row_hash, split = (spare(docs, n) for n in ("_drop_id", "_drop_hash", "_drop", "_hash", "_lines"))
    lines = exploded_lines(docs, text, doc_id, min_chars)
    repeated = (lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
                .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs))
    # a line of over a HOT-th of the documents: at most HOT times the lines that a document has on average
    met = join_unique(lines, repeated, ["h1", "h2"], F.col("n") * HOT > docs.count(), ["doc_id", "pos"])
    drops = (met.filter(F.col("n").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
             .groupBy(F.col("doc_id").alias(drop_id), F.col("row_hash").alias(drop_hash))
             .agg(F.collect_set("pos").alias(drop)))
    joined = docs.withColumn(row_hash, F.xxhash64(text)).join(
        drops, F.col(row_hash).eqNullSafe(F.col(drop_hash)) & F.col(doc_id).eqNullSafe(F.col(drop_id)), "left")
    parts = joined.withColumn(split, F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    # the positions that stay: a set difference, linear in the number of lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(drop))
    text_left = F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i)), "\n")
    return (parts.withColumn(kept, F.when(F.col(drop).isNull(), F.col(text)).otherwise(text_left))
            .withColumn("n_lines", F.size(split).cast("bigint"))
            .withColumn("n_dropped", F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)).cast("bigint"))
            .drop(split, drop, row_hash, drop_hash, drop_id))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_deduped(source: str) -> str:
    """CTEs ending in ``deduped`` (doc_id, n_lines, n_dropped, kept) for a table with unique doc_ids."""
    return f"""
line_lists AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
line_rows AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM line_lists),
line_keys AS (SELECT doc_id, pos, line,
    trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {SQL_WS}) AS k FROM line_rows),
line_bad AS (SELECT k, max(doc_id) AS keeper FROM line_keys WHERE length(k) >= 20
    GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
deduped AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.k) FILTER (WHERE l.doc_id <> b.keeper) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.k IS NULL OR l.doc_id = b.keeper), '') AS kept
  FROM line_keys l LEFT JOIN line_bad b ON l.k = b.k GROUP BY l.doc_id)"""


OP5_SQL = f"WITH {sql_deduped('documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
