"""Vector columns over ``ARRAY<DOUBLE>`` and the hashed bag-of-tokens embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK_DIM = 384  # fixed value: dimension reported when no vector is known


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression that is merely repeated inside a lambda is evaluated again for
    every element; a bound lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 when either vector is zero."""
    return let(norm(a) * norm(b), lambda s: F.when(s == 0, F.lit(0.0)).otherwise(dot(a, b) / s))


def unit(v: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    return let(v, lambda w: let(norm(w), lambda n: F.when(n == 0, w).otherwise(F.transform(w, lambda x: x / n))))


def min_max(v: Column) -> Column:
    """Scale to [0, 1]; a constant vector becomes zeros."""
    ends = F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    return let(ends, lambda e: F.transform(v, lambda x: F.when(e["high"] == e["low"], F.lit(0.0)).otherwise(
        (x - e["low"]) / (e["high"] - e["low"]))))


def z_score(v: Column) -> Column:
    """Zero mean, unit population deviation; a constant vector becomes zeros."""
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)
    return let(mean, lambda m: let(
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(v)),
        lambda sd: F.transform(v, lambda x: F.when(sd == 0, F.lit(0.0)).otherwise((x - m) / sd))))


def vector_issue(v: Column, tolerance: float = 1e-3) -> Column:
    """``missing``, ``empty``, ``not_finite``, ``zero``, ``not_unit`` or ``ok``."""
    inf = float("inf")
    not_finite = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (x == inf) | (x == -inf))
    return let(norm(v), lambda n: (
        F.when(v.isNull(), "missing")
        .when(F.size(v) == 0, "empty")
        .when(not_finite, "not_finite")
        .when(n == 0, "zero")
        .when(F.abs(n - 1) > tolerance, "not_unit")
        .otherwise("ok")
    ))


def token_bucket(token: Column, dim: int) -> Column:
    """Bucket of one token: the first 28 bits of its MD5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("int"), F.lit(dim))


def token_buckets(tokens: Column, dim: int) -> Column:
    return F.transform(tokens, lambda t: token_bucket(t, dim))
