"""Turning texts and tag definitions into vectors, and statistics over vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions import text as tx
from notemill.functions import vectors as vx

Encoder = Callable[[list[str]], np.ndarray]
MAX_CELLS = 1 << 18      # bucket numbers counted at once
MAX_TEXT = 4 << 20       # bytes of texts that a model gets at once, unless one text alone has more


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to at most ``limit``, of one entry at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def bucket_histogram(dim: int):
    """Arrow function: arrays of bucket numbers to L2-normalised bucket counts, one bincount per slice of a batch."""

    @F.arrow_udf("array<double>")
    def histogram(batch: pa.Array) -> pa.Array:
        sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        counts = np.zeros((len(sizes), dim))
        for a, b in _slices(sizes, MAX_CELLS):
            cells = batch.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype("int64")
            cells += np.repeat(np.arange(b - a), sizes[a:b]) * dim
            counts[a:b] = np.bincount(cells, minlength=dim * (b - a)).reshape(-1, dim)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        units = np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)
        offsets = pa.array(np.arange(len(sizes) + 1, dtype="int32") * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(units.ravel()), mask=batch.is_null())

    return histogram


def embed_hashed(df: DataFrame, text: str = "text", out: str = "vector", dim: int = 64) -> DataFrame:
    """Default embedder: L2-normalised token counts over hash buckets, without a shuffle.

    Tokens are cut and hashed on the JVM; only small bucket numbers travel to
    the Arrow histogram, which runs in the same Python stage as the routing.
    It measures shared words, not meaning; plug a model in with ``embed_with_model``.
    """
    buckets = vx.token_buckets(tx.words(F.lower(F.col(text))), dim)
    return df.withColumn(out, bucket_histogram(dim)(buckets))


def embed_with_model(df: DataFrame, load: Callable[[], Encoder], text: str = "text",
                     out: str = "vector") -> DataFrame:
    """Embed with a user model, loaded once per task.

    Only the text column travels to Python, in Arrow batches; each distinct
    text of a batch is encoded once, a few megabytes of texts at a time. ``load`` returns
    a function from a list of texts to a matrix.
    """

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            codes = batch.dictionary_encode()
            if not len(codes.dictionary):
                yield pa.nulls(len(batch), pa.list_(pa.float64()))
                continue
            texts = codes.dictionary
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            matrix = np.concatenate([np.asarray(model(texts.slice(a, b - a).to_pylist()), dtype="float64")
                                     for a, b in _slices(size, MAX_TEXT)])
            sizes = np.arange(len(matrix) + 1, dtype="int32") * matrix.shape[1]
            distinct = pa.ListArray.from_arrays(pa.array(sizes), pa.array(matrix.ravel()))
            yield distinct.take(codes.indices)

    return df.withColumn(out, encode(F.col(text)))


def embed_distinct(df: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "text",
                   out: str = "vector") -> DataFrame:
    """Compute each distinct text once over the whole data, then join the vectors back.

    Worth its two shuffles only for costly models. Copies collapse map-side in
    the distinct; adaptive execution splits a hot text in the join.
    """
    vectors = embed(df.select(text).filter(F.col(text).isNotNull()).distinct())
    return df.join(vectors.select(text, out), text, "left")


def tag_definition_vectors(tags: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vector of description and examples together."""
    text = tx.tag_definition_text(F.col("description"), F.col("examples"))
    return embed(tags.withColumn("text", text)).drop("text")


def tag_description_vectors(tags: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return embed(tags.withColumn("text", F.col("description"))).drop("text")


def mean_vectors(df: DataFrame, key: str, vector: str = "vector", out: str = "vector") -> DataFrame:
    """Mean vector per key; partial sums are merged before the shuffle."""
    return df.groupBy(key).agg(
        vector_to_array(Summarizer.mean(array_to_vector(vx.as_double(F.col(vector))))).alias(out),
        F.count(F.lit(1)).alias("n_examples"),
    )


def leave_one_out_means(df: DataFrame, key: str, fold: str, n_folds: int, vector: str = "vector") -> DataFrame:
    """(fold, key, vector, n): for each fold the mean vector per key of the rows outside it.

    One aggregate by (key, fold) serves all folds: a fold's mean is the total less the fold's own
    sum. A key without rows outside a fold has no row there.
    """
    parts = df.filter(F.col(vector).isNotNull()).groupBy(key, fold).agg(
        vector_to_array(Summarizer.sum(array_to_vector(vx.as_double(F.col(vector))))).alias("s"),
        F.count(F.lit(1)).alias("c"))
    # keys x folds rows from here on
    totals = parts.groupBy(key).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("s")))).alias("total"), F.sum("c").alias("of"))
    every = totals.withColumn(fold, F.explode(
        F.sequence(F.lit(0), F.lit(n_folds - 1)).cast(T.ArrayType(df.schema[fold].dataType))))
    left = F.col("of") - F.coalesce("c", F.lit(0))
    own = F.coalesce("s", F.transform("total", lambda _: F.lit(0.0)))
    return (every.join(parts, [key, fold], "left").withColumn("n", left).filter("n > 0")
            .select(fold, key, F.transform(F.zip_with("total", own, lambda a, b: a - b), lambda x: x / F.col("n")).alias("vector"), "n"))


def tag_example_vectors(tags: DataFrame, embed: Callable[[DataFrame], DataFrame], dim: int) -> DataFrame:
    """Mean of the example vectors; a tag without examples gets the zero vector."""
    examples = tags.select("tag", F.explode("examples").alias("text"))
    means = mean_vectors(embed(examples), "tag").drop("n_examples")
    zero = F.array_repeat(F.lit(0.0), dim)
    return tags.join(means, "tag", "left").withColumn("vector", F.coalesce("vector", zero))


def embedding_dimension(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.agg(F.coalesce(F.max(F.size(vector)), F.lit(vx.FALLBACK_DIM)).alias("dimension"))


def vector_quality(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Row counts per vector issue with norm statistics."""
    v = vx.as_double(F.col(vector))
    return df.select(vx.vector_issue(v).alias("issue"), vx.norm(v).alias("norm")).groupBy("issue").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("norm").alias("min_norm"),
        F.max("norm").alias("max_norm"),
        F.avg("norm").alias("avg_norm"),
    )


def diversity(df: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Mean pairwise cosine distance per key from the sum of unit vectors; no pairs are formed.

    Zero vectors have no direction and are left out.
    """
    units = df.withColumn("_v", vx.as_double(F.col(vector))).filter(vx.norm(F.col("_v")) > 0)
    sums = units.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.sum(array_to_vector(vx.unit(F.col("_v"))))).alias("_sum"),
    )
    n = F.col("n").cast("double")
    squared = vx.dot(F.col("_sum"), F.col("_sum"))
    return sums.select(
        key, "n", F.coalesce(1 - F.try_divide(squared - n, n * (n - 1)), F.lit(0.0)).alias("diversity")
    )


def vector_outliers(df: DataFrame, vector: str = "vector", deviations: float = 2.0) -> DataFrame:
    """Vectors whose distance to the overall mean exceeds mean + 2 deviations of that distance."""
    v = vx.as_double(F.col(vector))
    center = df.agg(vector_to_array(Summarizer.mean(array_to_vector(v))).alias("center"))
    gap = F.zip_with(v, F.col("_center"), lambda a, b: a - b)
    far = df.withColumn("_center", center.scalar()).withColumn("distance", vx.norm(gap)).drop("_center")
    stats = far.agg(F.struct(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std")).alias("s"))
    return (
        far.withColumn("_s", stats.scalar())
        .withColumn("limit", F.col("_s.mean") + deviations * F.col("_s.std"))
        .filter(F.col("distance") > F.col("limit"))
        .drop("_s")
    )


@dataclass(frozen=True)
class Axes:
    """Principal axes as rows, the variance along each, and the mean, all of bounded size."""

    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray


def fit_axes(df: DataFrame, vector: str = "vector") -> Axes:
    """All principal axes from one pass over the vectors.

    Tasks sum the products of the dimensions, taken about one of the vectors so that nothing
    cancels; the sums meet in an aggregate by dimension pair, and a dim x dim matrix
    reaches the driver. Of each axis the entry of largest size is positive. Rows without a vector
    are left out.
    """
    vectors = df.select(vx.as_double(F.col(vector)).alias("v")).filter(F.col("v").isNotNull())
    first = vectors.first()
    if first is None:
        raise ValueError("no vectors")
    origin = np.array(first["v"])
    d = len(origin)

    def sums(batches):
        gram = np.zeros((d + 1, d + 1))   # the last row and column hold sums and the number of rows
        for batch in batches:
            lists = batch.column(0)
            rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) - origin
            rows = np.hstack([rows, np.ones((len(rows), 1))])
            gram += rows.T @ rows
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j])],
                                         ["i", "j", "s"])

    total = np.zeros((d + 1, d + 1))
    for r in vectors.mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["s"]
    n, shift = total[d, d], total[d, :d] / total[d, d]
    covariance = (total[:d, :d] - n * np.outer(shift, shift)) / max(n - 1, 1)
    values, axes = np.linalg.eigh(covariance)
    axes = axes[:, ::-1].T
    axes *= np.sign(axes[np.arange(d), np.abs(axes).argmax(1)])[:, None]
    return Axes(origin + shift, np.ascontiguousarray(axes), np.maximum(values[::-1], 0.0))


def project(axes: Axes, k: int):
    """Column function: coordinates of a vector, less the mean, on the first ``k`` axes."""
    mean, directions = axes.mean, axes.components[:k].T

    @F.arrow_udf("array<double>")
    def coordinates(batch: pa.Array) -> pa.Array:
        sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out = np.zeros((len(batch), directions.shape[1]))
        flat = batch.flatten().to_numpy(zero_copy_only=False)
        out[sizes > 0] = (flat.reshape(-1, len(mean)) - mean) @ directions
        offsets = np.arange(len(batch) + 1, dtype="int32") * directions.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=batch.is_null())

    return coordinates


def reduce_dimensions(df: DataFrame, k: int, vector: str = "vector", out: str = "reduced") -> DataFrame:
    """PCA: adds the coordinates on the ``k`` principal axes (all of them where there are fewer)."""
    axes = fit_axes(df, vector)
    return df.withColumn(out, project(axes, k)(vx.as_double(F.col(vector))))
