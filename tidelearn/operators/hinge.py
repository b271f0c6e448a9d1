"""Hinge-loss gradient of a linear classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelearn.functions.vectors import UNROLL, dot


def signed(label: Column) -> Column:
    """Labels 0/1 or -1/+1 to -1/+1."""
    return F.when(label > 0, F.lit(1.0)).when(label <= 0, F.lit(-1.0))


def decision(x: Column, w: Column, b: Column, d: int | None = None) -> Column:
    return dot(x, w, d) + b


def sign_of(score: Column) -> Column:
    return F.when(score > 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def hinge_columns(d: int) -> list[Column]:
    """Aggregates ``m``, ``sum_y`` and, for narrow vectors, ``sum_yx``."""
    y = signed(F.col("label"))
    margin = y * decision(F.col("features"), F.col("weights"), F.col("intercept"), d)
    # The repeated margin is evaluated once per row in generated code.
    hit = F.when(margin < 1.0, y)
    out = [F.count(y).alias("m"), F.coalesce(F.sum(hit), F.lit(0.0)).alias("sum_y")]
    if d <= UNROLL:
        cells = [F.coalesce(F.sum(hit * F.col("features")[i]), F.lit(0.0)) for i in range(d)]
        out.append(F.array(*cells).alias("sum_yx"))
    else:
        out.append(hit.alias("_v"))
    return out


def hinge_sums(rows: DataFrame, keys: list[str], d: int, columns: list[Column] | None = None) -> DataFrame:
    """Per key: labelled rows ``m``, and the sums of ``y x`` and ``y`` over margin violators.

    Rows carry ``label``, ``features``, ``weights`` and ``intercept``.  Sums
    combine before the shuffle, so a key's rows are never gathered.
    """
    count, bias, last = columns or hinge_columns(d)
    if d <= UNROLL:
        return rows.groupBy(*keys).agg(count, bias, last)
    counts = rows.groupBy(*keys).agg(count, bias)
    parts = rows.select(*keys, last, F.posexplode("features").alias("i", "x")).filter("_v is not null")
    cells = parts.groupBy(*keys, "i").agg(F.sum(F.col("_v") * F.col("x")).alias("s"))
    packed = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("_m"))
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))
    )
    none = F.array_repeat(F.lit(0.0), d)
    joined = counts.join(packed, keys, "left")
    return joined.select(*keys, "m", "sum_y", F.when(F.col("_m").isNull(), none).otherwise(filled).alias("sum_yx"))


def svm_step(*, cost: float, step: float, step_intercept: float, merge: str):
    """New ``(weights, intercept, n)`` columns from the old ones and :func:`hinge_sums`."""
    m = F.coalesce(F.col("m"), F.lit(0)).cast("double")
    total = F.col("n") + m
    share = F.when(m > 0, m / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)) if merge == "count" else F.lit(1.0)
    rate = F.when(m > 0, F.lit(cost) / F.nullif(m, F.lit(0.0))).otherwise(F.lit(0.0))

    def moved(w: Column, s: Column) -> Column:
        return w - F.lit(step) * share * (w - rate * s)

    new_w = F.when(m > 0, F.zip_with("weights", "sum_yx", moved)).otherwise(F.col("weights"))
    new_b = F.when(
        m > 0, F.col("intercept") + F.lit(step_intercept) * share * rate * F.col("sum_y")
    ).otherwise(F.col("intercept"))
    return new_w, new_b, total.cast("long")
