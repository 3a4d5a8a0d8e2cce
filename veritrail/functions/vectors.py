"""Vector expressions over array<double> columns, evaluated in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def centred(v: Column) -> Column:
    return let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))


def unit(v: Column, least: float = 1e-12) -> Column:
    """v over its norm; null where the norm is not above the least."""
    return let(norm(v), lambda n: F.when(n > least, F.transform(v, lambda x: x / n)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def rmse(a: Column, b: Column) -> Column:
    """Root mean squared difference; null for empty vectors."""
    return F.sqrt(F.try_divide(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), F.size(a)))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """Cosine; null where the product of norms is not above the least."""
    size = norm(a) * norm(b)
    return F.when(size > least, dot(a, b) / size)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two vectors' entries; null where one is constant."""
    n = F.size(a).cast("double")
    cov = dot(a, b) / n - total(a) / n * total(b) / n
    var = lambda v: dot(v, v) / n - (total(v) / n) * (total(v) / n)
    spread = var(a) * var(b)
    return F.when(spread > 1e-24, cov / F.sqrt(spread))


def sign_agreement(a: Column, b: Column) -> Column:
    """Share of entries with a positive product; zeros count as disagreement."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x * y > 0, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def top_k(v: Column, k: int) -> Column:
    """Positions (from 0) of the k largest absolute values, the first of equals."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s.i)


def top_k_overlap(a: Column, b: Column, k: int) -> Column:
    return F.size(F.array_intersect(top_k(a, k), top_k(b, k))) / F.lit(float(k))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
