"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts in Arrow batches and are written once. The trees
are fitted in numpy on a bounded sample of labelled rows (``MAX_TRAIN``, chosen
by a hash of the id), flattened into arrays (feature, cut, children, value) and
applied to all rows of a batch at once: one step down all trees a level.

Defined results: a null text counts as empty and gets a score like any other;
labels that are null are left out, repeated labels of an id count once (the
largest), repeated documents of an id once in the fit (the one with the least statistics); very long texts are
read whole; equal gains take the first feature and cut; an empty table gives no rows; other columns are not
read; without labels the score is 0.5, with one class it is that class's
smoothed rate. Scores never see ids, languages, sources or labels.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import crc32_of_id, map_batches, stored, table

MAX_TRAIN = 20_000       # labelled rows that the fit sees at most
TREES, DEPTH, BINS, RATE, LEAST_LEAF, RIDGE = 60, 4, 64, 0.15, 20, 1.0

_SYMBOL = bytes(b"#*$%&|<>{}[]\\^~@=+_")
_DIGITS, _PUNCT = b"0123456789", b".,;:"
_UPPER = bytes(range(65, 91))
_WS = b" \t\n\r\x0b\x0c"
_MARKUP = re.compile(rb"https?://|www\.|</?[a-z]+[^>]{0,80}>")

FEATURES = ("log_chars", "log_words", "word_len", "symbol_share", "digit_share", "upper_share", "punct_share",
            "exclaim_share", "bar_share", "space_share", "distinct_words", "top_word", "dup_lines", "line_len",
            "short_lines", "dup_windows", "end_marks", "caps_words", "non_ascii", "markup", "one_letter", "long_words",
            "symbol_words", "max_word")


def statistics(text: bytes) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    n, words = len(text), text.split()
    k = len(words)
    if not k:
        return [float(np.log1p(n)), *[0.0] * (len(FEATURES) - 1)]
    drop = lambda chars: n - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x.strip()]
    lowered = text.lower().split()
    sizes = list(map(len, words))
    seen: dict[bytes, int] = {}
    for w in lowered:
        seen[w] = seen.get(w, 0) + 1
    windows = list(zip(lowered, lowered[1:], lowered[2:]))
    symbols = drop(_SYMBOL)
    return [
        float(np.log1p(n)), float(np.log1p(k)), sum(sizes) / k, symbols / n, drop(_DIGITS) / n, drop(_UPPER) / n,
        drop(_PUNCT) / n, text.count(b"!") / k, text.count(b"|") / k, drop(_WS) / n, len(seen) / k ** 0.8,
        max(seen.values()) / k, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(windows)) / max(1, len(windows)),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines) / len(lines),
        sum(map(bytes.isupper, words)) / k, (n - len(text.decode("utf-8", "replace"))) / n,
        len(_MARKUP.findall(text)) / k, sum(s == 1 for s in sizes) / k, sum(s > 20 for s in sizes) / k,
        min(1.0, symbols / k), float(np.log1p(max(sizes))),
    ]


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``x`` (array of float): the statistics of each text."""
    def run(batch: pa.RecordBatch):
        rows = [statistics(t or b"") for t in batch.column("_text").cast(pa.large_binary()).to_pylist()]
        x = pa.FixedSizeListArray.from_arrays(pa.array(np.array(rows, np.float32).ravel()), len(FEATURES))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], x.cast(pa.list_(pa.float32()))], [*keep, "x"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("x", T.ArrayType(T.FloatType()))])
    return map_batches(docs.select(*keep, F.col(text).alias("_text")), run, schema)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Boosted trees for the log loss over quantile bins, as flat arrays of complete trees.

    Node i of a tree has the children 2i + 1 and 2i + 2; a leaf above the lowest
    level is a node with an infinite cut, whose left child carries on its value.
    """
    nodes = 2 ** (DEPTH + 1) - 1
    feature, cut = np.zeros((TREES, nodes), np.int32), np.full((TREES, nodes), np.inf, np.float32)
    value = np.zeros((TREES, nodes))
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    out = {"feature": feature, "cut": cut, "value": value, "base": np.array(base)}
    if len(y) == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    margin = np.full(len(y), base)
    for t in range(TREES):
        p = _sigmoid(margin)
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        value[t, 0] = -RATE * grad.sum() / (hess.sum() + RIDGE)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            local = at - first
            g, h, c = (np.stack([np.bincount(local * BINS + binned[:, f], w, width * BINS).reshape(width, BINS)
                                 for f in range(x.shape[1])], 1) for w in (grad, hess, np.ones(len(y))))
            gl, hl, cl = g.cumsum(2), h.cumsum(2), c.cumsum(2)
            gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl ** 2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt ** 2 / (ht + RIDGE)
            gain[(cl < LEAST_LEAF) | (ct - cl < LEAST_LEAF)] = -1
            for node in range(width):
                f, b = np.unravel_index(gain[node].argmax(), gain[node].shape)
                i = first + node
                if gain[node, f, b] <= 1e-6 or b >= len(edges[f]):
                    value[t, 2 * i + 1] = value[t, 2 * i + 2] = value[t, i]
                    continue
                feature[t, i], cut[t, i] = f, edges[f][b]
                for child, gs, hs in ((1, gl[node, f, b], hl[node, f, b]),
                                      (2, gt[node, f, 0] - gl[node, f, b], ht[node, f, 0] - hl[node, f, b])):
                    value[t, 2 * i + child] = -RATE * gs / (hs + RIDGE)
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > cut[t, at])
        margin += value[t, at]
    return out


def score_trees(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1: all rows step down all trees together, a level at a time."""
    trees = np.arange(len(model["feature"]))[None, :]
    rows = np.arange(len(x))[:, None]
    at = np.zeros((len(x), trees.shape[1]), np.int64)
    for _ in range(DEPTH):
        at = 2 * at + 1 + (x[rows, model["feature"][trees, at]] > model["cut"][trees, at])
    return _sigmoid(model["base"] + model["value"][trees, at].sum(1))


def train_ids(known: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, _y, _order): at most ``max_rows`` of the labelled ids (doc_id, _y), the first by a hash of the id.

    A bound on the hash leaves about twice as many before the first are taken, so that
    no task sends more than its share of them.
    """
    hashed = known.filter(F.col("doc_id").isNotNull()).withColumn("_order", F.xxhash64(F.col("doc_id"), F.lit(17)))
    n = hashed.count()
    if n > 4 * max_rows:
        hashed = hashed.filter(F.col("_order") < int(-(1 << 63) + (1 << 64) * (2 * max_rows / n)))
    return hashed.select("doc_id", "_y", "_order").orderBy("_order", "doc_id").limit(max_rows)


def classify(docs: DataFrame, labels: DataFrame, learn_from, label: str = "quality", text: str = "text",
             max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, score): fitted on the rows of which ``learn_from`` (a condition on doc_id) holds."""
    rows = stored(with_statistics(docs, text), "statistics")
    known = labels.filter(learn_from & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    # the ids are chosen from the labels alone; only their statistics meet
    sample = (rows.join(F.broadcast(train_ids(known, max_train)), "doc_id").groupBy("doc_id", "_y", "_order")
              .agg(F.min("x").alias("x")).toPandas().sort_values(["_order", "doc_id"]))
    x = np.stack(sample["x"].to_list()).astype(np.float32) if len(sample) else np.zeros((0, len(FEATURES)), np.float32)
    model = docs.sparkSession.sparkContext.broadcast(fit_trees(x, sample["_y"].to_numpy(np.float64)))

    def run(batch: pa.RecordBatch):
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_trees(model.value, x))], ["doc_id", "score"])

    return map_batches(rows, run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op10_quality_trees(spark, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc32_of_id("doc_id") % 3 == 1, F.lit(False))
    scored = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
