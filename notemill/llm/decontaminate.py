"""Benchmark decontamination by greedy string tiling.

Candidate pairs of a document and a benchmark item share a seed: an equal
Karp-Rabin hash of ``min_match`` tokens in a row. For each pair the longest
match of unmarked tokens is marked again and again (all non-overlapping ones of
that length), until none has ``min_match`` tokens; tiles may lie in any order, so
that reordered passages are caught. An item is leaked by a document if its tiles
cover ``min_cover`` of the item's tokens.

The seeds of the benchmark go to all tasks if there are at most ``MAX_SEEDS``
of them, and then nothing is shuffled; beyond that documents and items meet in an
equi-join on the seed. Both ways tile the same pairs.

Defined results: tokens are lower-cased words of letters and digits; items with
fewer tokens than ``min_match`` are matched as a whole, items without tokens never;
null and empty texts match nothing; repeated items and rows each give their own
rows; a null id stays null; of equally long matches the first in the document is marked first; very long
texts are tiled whole; other columns are not read; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import map_batches, table
from notemill.llm.pretokenize import cuts, offsets_of

MIN_MATCH, MIN_COVER = 6, 0.6
MAX_SEEDS = 2_000_000    # 16 bytes each, and the items' tokens besides
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = re.compile(r"[^\W_]+")
_PAIRS = "doc_id bigint, item_id bigint, n_tokens int, covered int, n_tiles int, longest int, coverage double, leaked boolean"


def token_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words of all texts, and the offsets of the texts."""
    rows = [_WORD.findall((t or "").lower()) for t in texts]
    words = pa.array([w for row in rows for w in row], pa.large_string()).dictionary_encode()
    ids = np.array([_id_of(w.encode()) for w in words.dictionary.to_pylist()], np.uint64)
    return ids[words.indices.to_numpy()] if len(ids) else ids, offsets_of(np.array([len(r) for r in rows], np.int64))


def _id_of(word: bytes) -> int:
    return (zlib.crc32(word) << 32 | zlib.adler32(word)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def rolling(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``size`` tokens."""
    n = len(tokens) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size if n > 0 else 0):
            out = out * BASE + tokens[j:j + n]
    return out


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length), longest first."""
    size = min(min_match, len(item))
    if size == 0 or len(doc) < size:
        return []
    h_doc, h_item = rolling(doc, size), rolling(item, size)
    order = np.argsort(h_item, kind="stable")
    low, high = (np.searchsorted(h_item[order], h_doc, s) for s in ("left", "right"))
    hits = np.flatnonzero(high > low)
    counts = (high - low)[hits]
    i = np.repeat(hits, counts)
    j = order[np.repeat(low[hits] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    same = np.all([doc[i + k] == item[j + k] for k in range(size)], axis=0) if len(i) else np.zeros(0, bool)
    i, j = i[same], j[same]
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles = []
    while len(i):
        # windows of unmarked tokens only; windows in a row on a diagonal are one match
        taken_d, taken_i = (np.concatenate([[0], np.cumsum(~f)]) for f in (free_doc, free_item))
        free = (taken_d[i + size] == taken_d[i]) & (taken_i[j + size] == taken_i[j])
        i, j = i[free], j[free]
        if not len(i):
            break
        order = np.lexsort((i, i - j))
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(i) != 1)]))
        lengths = np.diff(np.append(starts, len(i))) + size - 1
        longest = int(lengths.max())
        best = starts[lengths == longest]
        for a, b in sorted(zip(i[best].tolist(), j[best].tolist())):
            if free_doc[a:a + longest].all() and free_item[b:b + longest].all():
                free_doc[a:a + longest] = free_item[b:b + longest] = False
                tiles.append((a, b, longest))
    return tiles


class Benchmark:
    """Items as token ids, and their seeds sorted, for use inside tasks."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int):
        flat, ends = token_ids([t for _, t in items])
        self.ids, self.min_match = [i for i, _ in items], min_match
        self.tokens = [flat[a:b] for a, b in zip(ends, ends[1:])]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}   # by window size: sorted hashes, their items
        by_size: dict[int, list[int]] = {}
        for k, t in enumerate(self.tokens):
            if len(t):
                by_size.setdefault(min(min_match, len(t)), []).append(k)
        for size, members in by_size.items():
            hashes = [rolling(self.tokens[k], size) for k in members]
            owner = np.repeat(members, [len(h) for h in hashes])
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            self.seeds[size] = (h[order], owner[order])

    def found_in(self, doc: np.ndarray) -> np.ndarray:
        """Positions of the items that share a seed with the document."""
        found = []
        for size, (hashes, owner) in self.seeds.items():
            h = np.unique(rolling(doc, size))
            low, high = (np.searchsorted(hashes, h, s) for s in ("left", "right"))
            hit = np.flatnonzero(high > low)
            found += [owner[a:b] for a, b in zip(low[hit], high[hit])]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def hits(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts of a batch that share a seed with some item: one look-up for the whole batch."""
        out = np.zeros(len(ends) - 1, bool)
        for size, (hashes, _) in self.seeds.items():
            h = rolling(flat, size)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            starts = np.flatnonzero(hashes[at] == h)
            row = np.searchsorted(ends, starts, "right") - 1
            out[row[starts + size <= ends[row + 1]]] = True
        return np.flatnonzero(out)


def _result(doc_id, item_id, doc, item, min_match, min_cover):
    tiles = tile(doc, item, min_match)
    covered = sum(t[2] for t in tiles)
    share = covered / len(item) if len(item) else 0.0
    return doc_id, item_id, len(item), covered, len(tiles), max((t[2] for t in tiles), default=0), share, share >= min_cover


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      [c.split()[0] for c in _PAIRS.split(", ")])


def tiled_pairs(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                min_match: int = MIN_MATCH, min_cover: float = MIN_COVER, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """A row for each document and item that share a seed: tokens, tiles, coverage and whether it is leaked."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("item_text"))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    # words are at least a character and a blank
    size = items.agg(F.sum(F.length("item_text") / 2 + 1).alias("n")).first()["n"] or 0
    schema = T.StructType.fromDDL(_PAIRS)
    if size <= max_seeds:
        sent = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in items.collect()], min_match))

        def run(batch: pa.RecordBatch):
            known, values = sent.value, batch.column(1).to_pylist()
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            for a, b in cuts(sizes, 4 << 20):
                flat, ends = token_ids(values[a:b])
                rows = []
                for k in known.hits(flat, ends):
                    doc = flat[ends[k]:ends[k + 1]]
                    rows += [_result(batch.column(0)[a + int(k)].as_py(), known.ids[m], doc, known.tokens[m], min_match,
                                     min_cover) for m in known.found_in(doc)]
                yield _batch(rows)

        return map_batches(texts, run, schema)

    def seeds(frame: DataFrame, value: str, key: str, windows: list[int]) -> DataFrame:
        def run(batch: pa.RecordBatch):
            flat, ends = token_ids(batch.column(1).to_pylist())
            keys, hashes, used = [], [], []
            for k in range(batch.num_rows):
                t = flat[ends[k]:ends[k + 1]]
                own = windows if value == "_text" else ([min(min_match, len(t))] if len(t) else [])
                for w in own:
                    h = np.unique(rolling(t, w))
                    keys.append(np.full(len(h), k))
                    hashes.append(h.view(np.int64))
                    used.append(np.full(len(h), w, np.int32))
            join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(join(keys, np.int64))),
                                              pa.array(join(hashes, np.int64)), pa.array(join(used, np.int32))],
                                             [key, "seed", "window"])

        return map_batches(frame.select(key, value), run, T.StructType.fromDDL(f"{key} string, seed bigint, window int"))

    digest = lambda i, t: F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("")), F.xxhash64(t))
    items, texts = items.withColumn("_item", digest("item_id", "item_text")), texts.withColumn("_doc", digest("doc_id", "_text"))
    of_items = seeds(items, "item_text", "_item", [])
    windows = [r[0] for r in of_items.select("window").distinct().collect()]   # at most min_match numbers
    met = seeds(texts, "_text", "_doc", windows).join(of_items, ["seed", "window"]).select("_doc", "_item").distinct()
    pairs = met.join(texts, "_doc").join(items, "_item").select("doc_id", "_text", "item_id", "item_text")

    def run_pairs(batch: pa.RecordBatch):
        docs_, ends = token_ids(batch.column(1).to_pylist())
        items_, stops = token_ids(batch.column(3).to_pylist())
        yield _batch([_result(batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), docs_[ends[k]:ends[k + 1]],
                              items_[stops[k]:stops[k + 1]], min_match, min_cover) for k in range(batch.num_rows)])

    return map_batches(pairs, run_pairs, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The pairs of which the document leaks the item."""
    return tiled_pairs(docs, benchmark, **options).filter("leaked")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The leaking documents with each item they leak."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("leaked")
