"""Synthetic labelled streams with known truth, one row per key of a given table."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from tidelearn.functions.noise import normals, uniform


def synth_regression(keys: DataFrame, coef: list[float], noise: float = 0.01, seed: int = 0, key: str = "seq") -> DataFrame:
    """Standard normal features and ``label = x . coef + noise``; ``coef`` is the truth kept by the caller."""
    draws = normals(F.col(key), seed, len(coef) + 1)
    named = keys.select(key, *[z.alias(f"_z{i}") for i, z in enumerate(draws)])
    label = reduce(add, [F.col(f"_z{i}") * F.lit(float(c)) for i, c in enumerate(coef)])
    return named.select(
        key,
        (label + noise * F.col(f"_z{len(coef)}")).alias("label"),
        F.array(*[F.col(f"_z{i}") for i in range(len(coef))]).alias("features"),
    )


def synth_classes(
    keys: DataFrame, d: int = 7, spread: float = 1.0, flip: float = 0.01, seed: int = 0, key: str = "seq"
) -> DataFrame:
    """Two classes 0/1 around ``-spread`` and ``+spread`` in every feature; a share ``flip`` of labels is wrong."""
    draws = normals(F.col(key), seed, d)
    named = keys.select(
        key,
        (uniform(F.col(key), seed, 1000) <= 0.5).alias("_c"),
        (uniform(F.col(key), seed, 1001) <= flip).alias("_f"),
        *[z.alias(f"_z{i}") for i, z in enumerate(draws)],
    )
    centre = F.when(F.col("_c"), F.lit(spread)).otherwise(F.lit(-spread))
    return named.select(
        key,
        F.when(F.col("_c") != F.col("_f"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
        F.array(*[F.col(f"_z{i}") + centre for i in range(d)]).alias("features"),
    )
