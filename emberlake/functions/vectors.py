"""Column functions for dense vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is zero or not a number."""
    below = norm(a) * norm(b)
    return F.when(below.isNull() | F.isnan(below) | (below == 0), F.lit(0.0)).otherwise(dot(a, b) / below)


def _finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: an expression named inside a lambda is computed at every step of it."""
    return F.transform(F.array(value), use)[0]


def valid(v: Column, least_norm: float = 1e-3) -> Column:
    """All components finite, and the norm above ``least_norm``."""
    return F.coalesce(_finite(doubles(v)) & (norm(v) > least_norm), F.lit(False))


def normalised(v: Column, least_norm: float = 1e-3) -> Column:
    """The unit vector, or null where the vector is not valid; time is linear in its length."""
    unit = lambda own: _bound(norm(own), lambda n: F.when(n > least_norm, F.transform(own, lambda x: x / n)))
    return _bound(doubles(v), lambda own: F.when(_finite(own), unit(own)))


def matches_sentinel(v: Column, sentinel: Column, least: float = 0.999) -> Column:
    return (F.size(v) == F.size(sentinel)) & (dot(v, sentinel) > least)


def trigram_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a text: words and their trigrams, hashed and counted.

    A stand-in for an embedding model, in built-in functions only. A text
    without words gives the first axis.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    grams = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3))))))
    axis = F.transform(grams, lambda g: F.conv(F.substring(F.sha2(g.cast("binary"), 256), 1, 8), 16, 10).cast("long") % dim)
    axes = F.sequence(F.lit(0), F.lit(dim - 1))
    tally = lambda own: F.transform(axes, lambda d: F.size(F.filter(own, lambda a: a == d)).cast("double"))
    unit = lambda c: _bound(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(c, lambda x: x / n))
    empty = F.transform(axes, lambda d: F.when(d == 0, 1.0).otherwise(0.0))
    return _bound(axis, lambda own: F.when(F.size(own) > 0, _bound(tally(own), unit)).otherwise(empty))
