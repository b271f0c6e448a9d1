"""Special functions as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, functions as F


def digamma(x: Column) -> Column:
    """Logarithmic derivative of the gamma function for x > 0.

    Shifts the argument by six and uses the asymptotic series; error near 1e-9.
    """
    z = x + F.lit(6.0)
    shift = reduce(add, [1.0 / (x + F.lit(float(i))) for i in range(6)])
    z2 = z * z
    series = F.ln(z) - 0.5 / z - 1.0 / (12.0 * z2) + 1.0 / (120.0 * z2 * z2) - 1.0 / (252.0 * z2 * z2 * z2)
    return series - shift


def digamma_np(x: np.ndarray) -> np.ndarray:
    """The same series for arrays inside a task."""
    z = x + 6.0
    z2 = z * z
    out = np.log(z) - 0.5 / z - 1.0 / (12.0 * z2) + 1.0 / (120.0 * z2**2) - 1.0 / (252.0 * z2**3)
    for i in range(6):
        out = out - 1.0 / (x + i)
    return out


def lgamma_np(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by the Stirling series after a shift."""
    shift = np.zeros_like(x)
    for i in range(6):
        shift = shift + np.log(x + i)
    z = x + 6.0
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3) + 1.0 / (1260.0 * z**5)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2.0 * np.pi) + series - shift


def log_sum_exp(values: Column) -> Column:
    """``ln(sum(exp(v)))`` of an array, shifted by its maximum."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return top + F.ln(total)
