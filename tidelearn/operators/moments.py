"""Second moments of labelled vectors: ``n``, ``sum x x'`` and ``sum y x``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidelearn.functions.vectors import triangle
from tidelearn.operators.prefix import running_total
from tidelearn.session import materialize

# Up to this width the sums are separate columns of one hash aggregate (465
# sums at 30); wider vectors are multiplied in Arrow batches.
FLAT = 30
# Windows whose sums are added up in one list per key; more of them are added up in blocks.
FEW = 1 << 16
# Cells a task may hold before it hands its partial sums on.
HELD_CELLS = 4_000_000


def cell_names(d: int) -> list[str]:
    return [f"xx_{i}_{j}" for i, j in triangle(d)] + [f"xy_{i}" for i in range(d)]


def moments(df: DataFrame, d: int, keys: list[str], features: str = "features", label: str = "label") -> DataFrame:
    """One row per key with the labelled count and one column per moment.

    Rows without a label, or with NaN, add nothing, but their key still gets a row.
    """
    if d > FLAT:
        raise ValueError(f"flat moments are for at most {FLAT} features; use moments_long")
    y = F.nullif(F.col(label).cast("double"), F.lit(float("nan")))
    x = F.when(y.isNotNull(), F.col(features))

    def total(cell: Column, name: str) -> Column:
        return F.coalesce(F.sum(cell), F.lit(0.0)).alias(name)

    sums = [total(x[i] * x[j], f"xx_{i}_{j}") for i, j in triangle(d)]
    sums += [total(y * x[i], f"xy_{i}") for i in range(d)]
    return df.groupBy(*keys).agg(F.count(y).alias("n"), *sums)


def pack(df: DataFrame, d: int, keep: list[str]) -> DataFrame:
    """Moment columns to the arrays ``xx`` (upper triangle) and ``xy``."""
    return df.select(
        *keep,
        "n",
        F.array(*[F.col(f"xx_{i}_{j}") for i, j in triangle(d)]).alias("xx"),
        F.array(*[F.col(f"xy_{i}") for i in range(d)]).alias("xy"),
    )


def unpack_np(xx: np.ndarray, d: int) -> np.ndarray:
    """Upper triangles ``(rows, d(d+1)/2)`` to symmetric matrices ``(rows, d, d)``."""
    i, j = np.triu_indices(d)
    full = np.zeros((xx.shape[0], d, d))
    full[:, i, j] = xx
    full[:, j, i] = xx
    return full


def moments_long(
    df: DataFrame, d: int, keys: list[str], features: str = "features", label: str | None = "label"
) -> DataFrame:
    """Moments in long form ``(keys, i, j, g)`` for any width.

    Each task multiplies its Arrow batches and emits one partial matrix per
    key, so the shuffle carries matrices, not rows.  Column ``j = d`` holds
    ``sum y x`` and the cell ``(d, d)`` the row count.
    """
    label_col = F.col(label).cast("double") if label else F.lit(0.0)
    rows = df.select(*keys, F.col(features).cast("array<double>").alias("_x"), label_col.alias("_y"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    prefix = f"{fields}, " if keys else ""
    upper = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    ii = np.array([i for i, _ in upper], dtype="int32")
    jj = np.array([j for _, j in upper], dtype="int32")
    limit = max(1, HELD_CELLS // len(upper))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def emit() -> Iterator[pd.DataFrame]:
            for key, g in held.items():
                out = pd.DataFrame({"i": ii, "j": jj, "g": g[ii, jj]})
                for name, value in zip(reversed(keys), reversed(key)):
                    out.insert(0, name, value)
                yield out
            held.clear()

        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                z = np.column_stack([np.stack(part["_x"].to_numpy()), part["_y"].to_numpy()])
                z = z[~np.isnan(z[:, d])]
                g = z.T @ z
                g[d, d] = len(z)
                held[key] = held[key] + g if key in held else g
            if len(held) > limit:
                yield from emit()
        yield from emit()

    cells = rows.mapInPandas(partial, f"{prefix}i int, j int, g double")
    return cells.groupBy(*keys, "i", "j").agg(F.sum("g").alias("g"))


def pack_long(df: DataFrame, d: int, keys: list[str]) -> DataFrame:
    """Long form to ``n``, ``xx`` and ``xy``; a key has at most (d+1)(d+2)/2 cells."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "g")))
    packed = df.groupBy(*keys).agg(cells.alias("c"))

    def pick(test) -> Column:
        return F.transform(F.filter("c", test), lambda e: e["g"])

    return packed.select(
        *keys,
        F.element_at(F.col("c"), -1)["g"].cast("long").alias("n"),
        pick(lambda e: e["j"] < d).alias("xx"),
        pick(lambda e: (e["j"] == d) & (e["i"] < d)).alias("xy"),
    )


def prefix_moments(rows: DataFrame, d: int, keys: list[str], order: str = "window_id") -> DataFrame:
    """Moments of each window together with all windows before it, packed.

    Sums are additive, so every model version comes from one pass: a sum per
    window, written once, then a running total over the windows, in blocks if there are many.
    """
    wide = d > FLAT
    sums = materialize((moments_long if wide else moments)(rows, d, [*keys, order]), "window-moments")
    lists = sums.where("i = 0 and j = 0") if wide else sums
    levels = {"levels": 0} if lists.limit(FEW + 1).count() <= FEW else {}
    if not wide:
        total = running_total(sums, keys, order, ["n", *cell_names(d)], **levels)
        return pack(total, d, [*keys, order])
    total = running_total(sums, [*keys, "i", "j"], order, ["g"], **levels)
    return pack_long(total, d, [*keys, order])


def merge_by_count(df: DataFrame, keys: list[str], weights: list[str], n: str = "n") -> DataFrame:
    """Count-weighted mean of models of the same key."""
    total = F.sum(n)
    means = [(F.sum(F.col(n) * F.col(w)) / total).alias(w) for w in weights]
    return df.groupBy(*keys).agg(total.alias(n), *means)

