"""Whitening of embeddings by a polarisation covariance.

Entries become integers (floor of ``scale`` times the entry). With n distinct vectors
and sums S, y = n x - S is a centred integer vector. Tasks add up exact squares only: of
every y_i and of every sum y_i + y_j. As (y_i + y_j)^2 - y_i^2 - y_j^2 = 2 y_i y_j, the
differences give every cross-covariance without rounding; the driver gets one row for each
pair of dimensions, whatever the number of vectors, and takes the matrix to ``eigh``.

Squares are summed in limbs of 26 bits with carries, so that no sum overflows; entries too
large for that go through Python's integers, with the same result.

Hot vectors: copies are combined in the tasks before the shuffle of the distinct step.

Defined results: rows whose vector is null or holds a null or non-finite entry, or one that
times ``scale`` reaches 2^62, are dropped; so are vectors of another length than most distinct
vectors have (ties: the longer). ``deviation`` is null where it needs more than 64 bits. A
component without variance has whitened and explained 0 and does not enter the identity error.
Fewer dimensions than ``components`` give as many components as there are. Repeated rows and
null ids stay as they are. Of each eigenvector the entry of largest size is positive. Without
vectors there are no rows. Only the columns ``keep`` are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm.common import map_batches, stored, table

SCALE, COMPONENTS = 256, 4
LIMB, LIMBS, SLICE = 26, 8, 1024     # bits and number of limbs; rows whose squares are added before a carry
WIDE = 1 << 62
MAX_DIMENSIONS = 2_048   # the driver holds a matrix of this size at most


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """The vector's entries as integers; null where it is not to be used."""
    usable = F.coalesce(F.forall(vector, lambda e: F.abs(e.cast("double") * scale) < float(WIDE)), F.lit(False))
    return F.when(usable, F.transform(vector, lambda e: F.floor(e.cast("double") * scale).cast("bigint")))


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, d)


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sums of the dimensions of column ``x``."""
    low = (1 << 31) - 1

    def run(batches):
        n, sums = 0, np.zeros((2, d), np.int64)
        for batch in batches:
            x = _matrix(batch, "x", d)
            n += len(x)
            sums += np.stack([(x & low).sum(0), (x >> 31).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)),
                                          pa.array(sums[0]), pa.array(sums[1])], ["k", "n", "low", "high"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = (fit.mapInArrow(run, "k int, n bigint, low bigint, high bigint").groupBy("k")
            .agg(exact("n"), exact("low"), exact("high")).collect())
    by = {r["k"]: r for r in rows}
    return int(by[0]["n"]), [int(by[k]["low"]) + (int(by[k]["high"]) << 31) for k in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, as int64 where all of it stays below 2^62, else as Python's integers."""
    if not len(x):
        return x
    reach = max(max(abs(n * int(v)), abs(n * int(v) - s)) for edge in (x.min(0), x.max(0)) for v, s in zip(edge, sums))
    if reach < WIDE and max(map(abs, sums)) < WIDE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def add_squares(total: np.ndarray, values: np.ndarray) -> None:
    """Adds the sums of squares of the columns of ``values`` to ``total`` (limbs x columns), and carries."""
    if values.dtype == object:
        left = (values * values).sum(0)
        for k in range(LIMBS - 1):
            total[k] += (left & ((1 << LIMB) - 1)).astype(np.int64)
            left = left >> LIMB
        total[LIMBS - 1] += left.astype(np.int64)
    else:
        size = np.abs(values)
        parts = [size]
        while int(parts[-1].max(initial=0)) >> LIMB:
            top = parts.pop()
            parts += [top & ((1 << LIMB) - 1), top >> LIMB]
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[i:], i):
                both = np.einsum("rc,rc->c", a, b)      # below 2^62: SLICE products of 52 bits
                carry = both >> LIMB
                times = 1 if i == j else 2
                total[i + j] += times * (both - (carry << LIMB))
                total[i + j + 1] += times * carry
    for k in range(LIMBS - 1):
        carry = total[k] >> LIMB
        total[k] -= carry << LIMB
        total[k + 1] += carry


def squares(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of squares: (i, i) of y_i, (i, j) with i < j of y_i + y_j."""
    d = len(sums)
    ends = np.cumsum([0, *range(d, 0, -1)])

    def run(batches):
        total = np.zeros((LIMBS, int(ends[-1])), np.int64)
        for batch in batches:
            x = _matrix(batch, "x", d)
            for a in range(0, len(x), SLICE):
                y = centred(x[a:a + SLICE], n, sums)
                for i in range(d):
                    pair = y[:, i:] + y[:, i:i + 1]
                    pair[:, 0] = y[:, i]
                    add_squares(total[:, ends[i]:ends[i + 1]], pair)
        i = np.repeat(np.arange(d), np.arange(d, 0, -1))
        j = np.arange(len(i)) - ends[i] + i
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          *[pa.array(limb) for limb in total]], ["i", "j", *names])

    names = [f"limb{k}" for k in range(LIMBS)]
    rows = (fit.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} bigint" for c in names))
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]))
    return {(r["i"], r["j"]): sum(r[c] << (LIMB * k) for k, c in enumerate(names)) for r in rows.collect()}


def covariance(square: dict[tuple[int, int], int], n: int, d: int) -> np.ndarray:
    """The covariance of x with divisor n, from the sums of squares; each entry is rounded once."""
    out = np.empty((d, d))
    for (i, j), s in square.items():
        product = s if i == j else (s - square[i, i] - square[j, j]) // 2
        out[i, j] = out[j, i] = product / n ** 3
    return out


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> dict:
    """n, S, trace, eigenvalues, unit eigenvectors (as columns) of column ``x`` of distinct vectors."""
    n, sums = column_sums(fit, d)
    v = covariance(squares(fit, n, sums), n, d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    trace = float(np.trace(v))
    values = np.where(values > trace * d * 2.0 ** -52, values, 0.0)
    return {"n": n, "sums": sums, "trace": trace, "values": values, "vectors": vectors}


def project(y: np.ndarray, model: dict) -> np.ndarray:
    """Whitened components of centred rows y = n x - S."""
    scale = np.where(model["values"] > 0, 1 / np.sqrt(np.where(model["values"] > 0, model["values"], 1)), 0.0)
    return (y / model["n"]).astype(np.float64) @ model["vectors"] * scale


def identity_error(fit: DataFrame, model: dict) -> float:
    """Largest entry of the whitened covariance over ``fit`` minus the identity, of components with variance."""
    c, d = len(model["values"]), len(model["sums"])

    def run(batch: pa.RecordBatch):
        w = project(centred(_matrix(batch, "x", d), model["n"], model["sums"]), model)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, k])) for k in range(c)], [f"w{k}" for k in range(c)])

    live = [k for k in range(c) if model["values"][k] > 0]
    pairs = [(a, b) for a in live for b in live if a <= b]
    if not pairs:
        return 0.0
    whitened = map_batches(fit, run, T.StructType([T.StructField(f"w{k}", T.DoubleType()) for k in range(c)]))
    row = whitened.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def _deviation(y: np.ndarray) -> pa.Array:
    if y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
        return pa.array((y * y).sum(1), pa.int64())
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), scale: int = SCALE,
           components: int = COMPONENTS) -> DataFrame:
    """For each used row and component: ``keep``, component, n, deviation, whitened, explained, identity_error."""
    given = [vectors.schema[c] for c in keep]
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = T.StructType([*given, *T.StructType.fromDDL(
        "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields])
    rows = vectors.select(*keep, quantised(F.col(vector), scale).alias("_x")).filter("_x IS NOT NULL")
    distinct = stored(rows.select(F.col("_x").alias("x")).distinct(), "distinct_vectors")
    most = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    if not d:
        return vectors.sparkSession.createDataFrame([], schema)
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of over {MAX_DIMENSIONS} dimensions")
    distinct = distinct.filter(F.size("x") == d)
    model = fit_whitening(distinct, d, components)
    error = identity_error(distinct, model)
    explained = model["values"] / model["trace"] if model["trace"] > 0 else np.zeros(len(model["values"]))

    def run(batch: pa.RecordBatch):
        y = centred(_matrix(batch, "_x", d), model["n"], model["sums"])
        c, m = len(explained), batch.num_rows
        at = pa.array(np.repeat(np.arange(m), c))
        yield pa.RecordBatch.from_arrays([
            *[batch.column(k).take(at) for k in keep], pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
            pa.array(np.full(m * c, model["n"], np.int64)), _deviation(y).take(at), pa.array(project(y, model).ravel()),
            pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error))], [*keep, *names])

    return map_batches(rows.filter(F.size("_x") == d), run, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
