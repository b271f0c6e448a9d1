"""Column helpers for ``array<double>`` vectors."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# Widths up to this are unrolled so that they stay inside generated code.
UNROLL = 64


def dot(x: Column, w: Column, d: int | None = None) -> Column:
    """Inner product of two vectors; unrolled when the width is known and small."""
    if d is not None and d <= UNROLL:
        return reduce(add, [x[i] * w[i] for i in range(d)])
    products = F.zip_with(x, w, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def clamp_at_zero(w: Column) -> Column:
    """Every coefficient below zero becomes zero."""
    return F.transform(w, lambda c: F.greatest(c, F.lit(0.0)))


def densify(size: Column | int, indices: Column, values: Column) -> Column:
    """Sparse ``(size, indices, values)`` to a dense vector; absent entries are 0.

    An index outside ``0 .. size - 1`` makes the vector null, so that width checks reject the row.
    """
    size = F.lit(size) if isinstance(size, int) else size
    lookup = F.map_from_arrays(indices, values)
    dense = F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.try_element_at(lookup, i), F.lit(0.0))
    )
    return F.when(~F.exists(indices, lambda i: (i < 0) | (i >= size)), dense)


def has_width(x: Column, d: int) -> Column:
    """True for vectors of width ``d`` without missing entries."""
    return (F.size(x) == d) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


def triangle(d: int) -> list[tuple[int, int]]:
    """Index pairs of the upper triangle, row by row."""
    return [(i, j) for i in range(d) for j in range(i, d)]
