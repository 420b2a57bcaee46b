"""Vector similarity as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def maxsim(query: Column, doc: Column) -> Column:
    """Sum over the query's vectors of the best cosine with a vector of the document; 0 without vectors."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: cosine(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 where either side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two maps term -> weight."""
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + a[k] * F.coalesce(b[k], F.lit(0.0)))
