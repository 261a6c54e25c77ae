"""From documents to token ids: toxicity, line de-duplication, near-duplicates, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and is written as Parquet before the next one starts. Columns other than those
named are passed on; all stages but the last return the columns of documents.

Defined results: rows with a null text go through every stage as empty texts (they
are near-duplicates of each other, so that one of them stays); rows without an id are documents
like any other; repeated rows are one document, of which one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill.llm import bpe, decontaminate, lines, simhash, toxicity
from notemill.llm.common import crc32_of_id, fits, spare, stored, table

MAX_TOXICITY = 0.3
BROADCAST_IDS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``MAX_TOXICITY``; fitted as the toxicity query is. Labels from which
    nothing can be learnt (none, or of one class) drop no document."""
    learned = ~F.coalesce(crc32_of_id("doc_id") % 4 == 2, F.lit(False))
    model = toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learned)
    if not model["slope"]:
        return docs
    score = spare(docs, "_toxicity")
    scored = toxicity.score_texts(docs, model, keep=tuple(docs.columns), into=score)
    return scored.filter(F.col(score) < MAX_TOXICITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in other documents too."""
    # columns with the names of the operator's results are kept under others meanwhile
    names = {c: spare(docs, f"_{c}") if c.lower() in ("n_lines", "n_dropped") else c for c in docs.columns}
    kept = spare(docs, "_kept")
    done = lines.dedup_lines(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), kept=kept)
    changed = {"text": F.col(kept), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length(kept).cast("bigint"))
               .otherwise(F.col("n_chars"))}
    return done.select(*[changed.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one document: the one with the least id, then by a hash of the text.

    Rows without an id come after all others; of rows with one id and text one stays.
    """
    id_, one, two, n = (spare(docs, c) for c in ("_id", "_one", "_two", "_n"))
    keyed = docs.withColumns({one: F.xxhash64("text"), two: F.xxhash64(F.lit(1), "text")})
    groups = simhash.near_duplicates(keyed.select("doc_id", "text", one, two), keep=(one, two))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", one, two)).alias("f"))
    # one row a group; hashes lie in the rows themselves, so that whole documents meet by their own key
    stay = first.select(F.col("f.doc_id").alias(id_), F.col(f"f.{one}").alias(f"{one}_"), F.col(f"f.{two}").alias(f"{two}_"))
    met = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(one) == F.col(f"{one}_")) & (F.col(two) == F.col(f"{two}_")),
                     "left_semi")
    same = Window.partitionBy("doc_id", one, two).orderBy(one)
    return met.withColumn(n, F.row_number().over(same)).filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text leaks no benchmark item; equal texts share a verdict, so that ids do not matter."""
    key, leak = spare(docs, "_key"), spare(docs, "_leak")
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = stored(decontaminate.leaks(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    if fits(found, BROADCAST_IDS):
        found = F.broadcast(found)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return keyed.join(found, F.col(key) == F.col(leak), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and ids, with the digests of the ids and of the bytes that they decode to.

    Words are folded by Spark's functions, as the query of the operator does it.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, drop_text=True,
                      then=bpe.digests(spark, path, keep=("lang", "source", "ids")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

ORACLE_SQL = None   # string kernels, fingerprints and merges are beyond SQL; see the brute-force tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
