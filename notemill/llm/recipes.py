"""Exact de-duplication by recipes of content-defined chunks. DataFrame functions only.

A text is cut where its content says so: after a sentence end or a line break that
stands at least MIN_CHUNK characters behind the last cut, or after MAX_CHUNK
characters. The chunks of all documents are made distinct by their content, which is
the only time that text is shuffled (copies are combined before), and each gets an
identifier of ``width`` 64-bit hashes. Identifiers are verified against the distinct
contents: if two contents share one, all are widened by a further hash and verified
again. A document's recipe is the ordered list of its identifiers; as cuts depend on
the text alone, texts are equal exactly if their recipes are. Recipes are about a
thirtieth of the text, and only they are grouped and joined.

Hot groups: copies are combined per task before the shuffle; the verdicts of groups
with over a HOT-th of all rows (fewer than HOT groups) are broadcast, the other verdicts
are joined by recipe.

Defined results: a null text counts as empty; empty texts are equal. Text that is not
valid UTF-8 is one chunk, compared by its bytes. Of equal texts the row with the largest
id stays; rows without an id come before all others; of rows with the same id and text
one stays. Very long texts have long recipes and no other cost. An empty table gives no
rows. Further columns are passed on, those with the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.common import join_unique, spare, stored, table

MIN_CHUNK, MAX_CHUNK = 400, 4000     # code points
WIDTH = 2                # 64-bit hashes of an identifier at the start
HOT = 5_000
CUTS = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[.!?]\s|\n)|.{{1,{MAX_CHUNK}}}"
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    body = F.coalesce(text, F.lit(""))
    return F.when(F.is_valid_utf8(body), F.regexp_extract_all(body, F.lit(CUTS), F.lit(0))).otherwise(F.array(body))


def identifier(chunk: Column, width: int, bits: int = 64) -> list[Column]:
    """``width`` hashes of a chunk with different seeds, of ``bits`` bits each."""
    return [F.shiftrightunsigned(F.xxhash64(F.lit(seed), chunk), 64 - bits) for seed in range(width)]


def verified_width(docs: DataFrame, text: str = "text", width: int = WIDTH, bits: int = 64) -> int:
    """The least number of hashes, from ``width`` on, under which no two different chunks of ``docs`` share an identifier."""
    distinct = docs.select(F.explode(chunks(F.col(text))).alias("chunk")).distinct()
    while True:
        shared = (distinct.select(*[c.alias(f"h{i}") for i, c in enumerate(identifier(F.col("chunk"), width, bits))])
                  .groupBy(*[f"h{i}" for i in range(width)]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        if shared.isEmpty():
            return width
        width += 1


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 64,
                 width: int = WIDTH) -> DataFrame:
    """The columns of ``docs`` without the text, and keep_id, group_size, kept and text_sha256.

    ``doc_id`` names an integer column. ``bits`` and ``width`` set the size of the identifiers.
    """
    width = verified_width(docs, text, width, bits)
    recipe, row, rank = (spare(docs, n) for n in ("_recipe", "_row", "_rank"))
    others = [c for c in docs.columns if c != text and c.lower() not in RESULTS]
    lists = F.flatten(F.transform(chunks(F.col(text)), lambda c: F.array(*identifier(c, width, bits))))
    rows = stored(docs.select(*[F.col(f"`{c}`") for c in others], lists.alias(recipe),
                              F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"),
                              F.monotonically_increasing_id().alias(row)), "recipes")
    # one number that orders rows by id, then by place; a row without an id is below all others
    order = (F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
             * F.lit(1 << 62).cast("decimal(19,0)") + F.col(row).cast("decimal(19,0)"))
    ranked = rows.withColumn(rank, order)
    groups = stored(ranked.groupBy(recipe).agg(F.max(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
                                               F.max(rank).alias("_first")), "groups")
    hot = F.col("group_size") * HOT > rows.count()
    joined = join_unique(ranked, groups, [recipe], hot, [row])
    return joined.select(*[F.col(f"`{c}`") for c in others], "keep_id", "group_size",
                         (F.col(rank) == F.col("_first")).alias("kept"), "text_sha256")


def op11_chunk_recipes(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
