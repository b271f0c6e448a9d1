"""Repeatable noise: a draw depends only on the row key, a seed and a stream number.

``randn`` depends on how rows are spread over partitions; these draws do not,
so a task that is run again gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# 13 hex digits of a digest give 52 random bits.
DIGITS = 13
SCALE = float(16**DIGITS)


def _digest(key: Column, seed: int, stream: int) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(stream))))


def _unit(digest: Column, start: int) -> Column:
    """A double in (0, 1] from part of a hex digest."""
    bits = F.conv(F.substring(digest, start, DIGITS), 16, 10).cast("double")
    return (bits + 1.0) / SCALE


def uniform(key: Column, seed: int, stream: int) -> Column:
    return _unit(_digest(key, seed, stream), 1)


def normal_pair(key: Column, seed: int, stream: int) -> tuple[Column, Column]:
    """Two independent standard normal draws (polar form of two uniforms)."""
    digest = _digest(key, seed, stream)
    radius = F.sqrt(-2.0 * F.ln(_unit(digest, 1)))
    angle = 2.0 * math.pi * _unit(digest, 1 + DIGITS)
    return radius * F.cos(angle), radius * F.sin(angle)


def normals(key: Column, seed: int, count: int) -> list[Column]:
    out: list[Column] = []
    for stream in range((count + 1) // 2):
        out.extend(normal_pair(key, seed, stream))
    return out[:count]
