"""Column helpers over arrays: running sums, dot products, folds that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def total(numbers: Column) -> Column:
    """Sum of an array of integers; 0 if it is empty."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def block_sums(numbers: Column) -> Column:
    """Sums of whole blocks of BLOCK numbers, for prefix_sum."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / BLOCK).cast("int")), lambda b: total(F.slice(numbers, b * BLOCK + 1, BLOCK)))


def prefix_sum(numbers: Column, sums: Column, upto: Column) -> Column:
    """Sum of the first `upto` numbers, from the block sums and the rest: far fewer steps than one sum for each place."""
    blocks = F.floor(upto / BLOCK).cast("int")
    return total(F.slice(sums, F.lit(1), blocks)) + total(F.slice(numbers, blocks * BLOCK + 1, upto - blocks * BLOCK))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; arrays must have one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalised(a: Column) -> Column:
    """The vector over its norm, which counts as 1e-12 at least."""
    size = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / size)


def truncated(a: Column, dim: int, allowed: tuple[int, ...]) -> Column:
    """The leading `dim` components, normalised again. `dim` must be one of `allowed`, and no vector may be shorter."""
    if dim not in allowed:
        raise ValueError(f"dim must be one of {allowed}")
    return F.when(F.size(a) >= dim, normalised(F.slice(a, 1, dim))).otherwise(F.raise_error(F.lit(f"vector has fewer than {dim} components")))
