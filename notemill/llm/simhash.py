"""SimHash near-duplicates by a binary trie joined with itself.

Distinct fingerprints form a binary trie by their bits. Two nodes are visited
together; going down, each differing bit is added up and a pair is left as soon
as it has more than the error budget. The upper levels are dealt out by Spark:
at depth D every fingerprint goes to the node pairs (own prefix, prefix with up
to k bits flipped), and each pair of subtrees is walked in a task of its own.
D grows with the number of fingerprints, so that subtrees keep their size; the
copies sent are 1 + D + D(D-1)/2 for two bits. A fingerprint has at most 2,080
others within two bits, so that links stay in proportion to distinct ones.

Defined results: a null or empty text, or one without words, has fingerprint 0,
which links like any other. Equal fingerprints are one node; repeated rows each get their row. A null doc_id takes
part but is no component's id unless all are null. Very long texts are read whole, their bits counted in
steps. Other columns are left out but for ``keep``. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import join_unique, map_batches, stored, table

HUBS = 1_000             # a node with over this part of all links is joined by broadcast
SUBTREE = 2048           # fingerprints of a subtree that one task walks, about
_STEP = 1 << 19          # shingles whose bits are counted at once


def _hashes(text: bytes, words: int) -> list[int]:
    w = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if not w:
        return []
    if len(w) <= words:
        return [digest(b" ".join(w), 42)]
    return [digest(b" ".join(w[i:i + words]), 42) for i in range(len(w) - words + 1)]


def _majority(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Fingerprints of texts from their shingle hashes, one text after another (sizes of at least 1)."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = np.zeros((len(sizes), 64), np.int64)
    for a in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[a:a + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, a + len(bits), "left"))
        counts[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - a, 0), axis=0, dtype=np.int64)
    over = (2 * counts > np.array(sizes)[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view(np.int64)[:, 0]


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, ``keep``): 64-bit SimHash over ``words``-word shingles, repeats included."""
    def run(batch: pa.RecordBatch):
        values, fps = batch.column(1).cast(pa.large_binary()).to_pylist(), np.zeros(batch.num_rows, np.int64)
        rows, sizes, hashes, total = [], [], [], 0

        def flush():
            if rows:
                fps[rows] = _majority(np.concatenate(hashes), sizes)

        for i, value in enumerate(values):
            h = _hashes(value or b"", words)
            if h:
                rows.append(i)
                sizes.append(len(h))
                hashes.append(np.array(h, np.uint64))
                total += len(h)
            if total > _STEP:
                flush()
                rows, sizes, hashes, total = [], [], [], 0
        flush()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *keep])

    schema = T.StructType([*T.StructType.fromDDL("doc_id bigint, fp bigint").fields, *[docs.schema[c] for c in keep]])
    return map_batches(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text"), *keep), run, schema)


def walk(left: np.ndarray, right: np.ndarray, same: bool, budget: int, block: int = 1 << 18
         ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted uint64 ``left`` and ``right`` that differ in at most ``budget`` bits.

    Visits pairs of trie nodes, given as ranges, depth by depth; wide fronts are
    cut in blocks, of which one is kept on while the others wait.
    """
    zeros = {}

    def split(side: int, values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
        if (side, bit) not in zeros:
            zeros[side, bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1) == 0)])
        z = zeros[side, bit]
        return low + z[high] - z[low]

    one = lambda x: np.array([x], np.int64)
    waiting = [(63, one(0), one(len(left)), one(0), one(len(right)), one(0), np.array([same]))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while waiting:
        bit, a, b, c, d, used, twin = waiting.pop()
        single = (b - a == 1) & (d - c == 1)
        if bit < 0 or single.any():
            done = single if bit >= 0 else np.ones(len(a), bool)
            x, y, t = a[done], c[done], twin[done]
            ok = (np.bitwise_count(left[x] ^ right[y]) <= budget) & ~t
            found.append((x[ok], y[ok]))
            a, b, c, d, used, twin = (v[~done] for v in (a, b, c, d, used, twin))
        if not len(a):
            continue
        m, n = split(0, left, a, b, bit), split(1, right, c, d, bit)
        parts = [(a, m, c, n, used, twin), (m, b, n, d, used, twin), (a, m, n, d, used + 1, np.zeros_like(twin)),
                 *[tuple(v[~twin] for v in (m, b, c, n, used + 1, twin))]]
        front = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (front[1] > front[0]) & (front[3] > front[2]) & (front[4] <= budget)
        front = [x[live] for x in front]
        for k in range(0, len(front[0]), block):
            waiting.append((bit - 1, *[x[k:k + block] for x in front]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def close_pairs(distinct: DataFrame, max_bits: int = 2, subtree: int = SUBTREE) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    n = distinct.count()
    depth = min(28, max(0, math.ceil(math.log2(max(1, n / subtree)))))
    masks = [0]
    for _ in range(max_bits):
        masks = sorted({m | (1 << i) for m in masks for i in range(depth)} | set(masks))
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("bigint")
    sent = (distinct.select("fp", prefix.alias("own"))
            .select("fp", "own", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask"))
            .select("fp", F.least(F.col("own"), F.col("own").bitwiseXOR(F.col("mask"))).alias("lower"),
                    F.greatest(F.col("own"), F.col("own").bitwiseXOR(F.col("mask"))).alias("upper"), "own"))

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        twin = group["lower"].iat[0] == group["upper"].iat[0]
        fp = group["fp"].to_numpy().view(np.uint64)
        low = np.sort(fp[(group["own"] == group["lower"]).to_numpy()])
        high = low if twin else np.sort(fp[(group["own"] == group["upper"]).to_numpy()])
        x, y = walk(low, high, bool(twin), max_bits)
        return pd.DataFrame({"a": low[x].view(np.int64), "b": high[y].view(np.int64)})

    return sent.groupBy("lower", "upper").applyInPandas(pairs, "a bigint, b bigint")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components of links (a, b), alternating large and small stars.

    Neighbourhoods are only ever reduced to their least node, so that a hub is
    an aggregate and a (splittable) join, never a group in one task.
    """
    def star(edges: DataFrame, large: bool, n: int) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        if not large:
            both = both.filter(F.col("v") < F.col("u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # a node of over a HUBS-th of the links is one of few
        joined = join_unique(both, least, ["u"], F.col("n") * HUBS > 2 * n, ["v"])
        if large:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.filter(F.col("a") != F.col("b")).distinct()

    edges = stored(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    before, n = None, edges.count()
    for _ in range(rounds):
        # each star reads written links: one over the other would stand six times in the plan
        large = stored(star(edges, True, n), "large_stars")
        edges = stored(star(large, False, n), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before, n = tuple(now), now[0]
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3,
                    max_bits: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id, root, ``keep``): component_id is the least doc_id reachable over links, root a fingerprint
    that stands for the component."""
    fps = stored(fingerprints(docs, text, doc_id, words, keep), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(close_pairs(nodes.select("fp"), max_bits))
    grown = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        nodes["fp"], "least", F.coalesce("root", nodes["fp"]).alias("root"))
    least = grown.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grown.join(least, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return fps.join(named, fps["fp"] == named["_fp"]).select("doc_id", "fp", "component_id", "root", *keep)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
