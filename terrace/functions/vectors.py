"""Column expressions for vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column, dim: int | None = None) -> Column:
    """The first ``dim`` values at length one; null if there are fewer."""
    cut = F.when(F.size(v) >= dim, F.slice(v, 1, dim)) if dim else v
    cut = F.transform(cut, lambda x: x.cast("double"))
    norm = F.greatest(F.sqrt(F.aggregate(cut, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(F.array(F.struct(cut.alias("v"), norm.alias("n"))), lambda p: F.transform(p["v"], lambda x: x / p["n"]))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def append_distinct(old: Column, new: Column, cap: int | None = None) -> Column:
    """Distinct union in order, capped."""
    both = F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    return F.slice(both, 1, cap) if cap else both
