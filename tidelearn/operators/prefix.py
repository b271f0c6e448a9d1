"""Running totals over an integer order, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 4096
# Levels of blocks: with two of them any 64-bit order that counts ranges of 2^17 keys (see ``windows.RANGE``)
# leaves a top list of at most 2^22 entries, however sparse the keys.
LEVELS = 2


def running_total(
    df: DataFrame, keys: list[str], order: str, values: list[str], block: int = BLOCK, inclusive: bool = True, levels: int = LEVELS
) -> DataFrame:
    """Replace each column of ``values`` by its running total along ``order``.

    ``order`` is an integer, unique per key.  Totals are taken per
    block of ``block`` positions, the list of blocks is summed in order (itself in
    blocks, ``levels`` times), and each block then runs on its own.  A key of N positions gives
    groups of at most ``block`` rows, never one group of N.  ``levels=0`` sums a key's list, known to be short, as a whole.
    """
    if not levels:
        whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        rest = [c for c in df.columns if c not in values]
        return df.select(*rest, *[F.coalesce(F.sum(v).over(whole), F.lit(0)).alias(v) for v in values])
    blocked = df.withColumn("_block", F.expr(f"cast(`{order}` as bigint) div {block}L"))
    totals = blocked.groupBy(*keys, "_block").agg(*[F.sum(v).alias(v) for v in values])
    if levels > 1:
        # The name of this level's block is free again one level down.
        inner = totals.withColumnRenamed("_block", "_order")
        totals = running_total(inner, keys, "_order", values, block, False, levels - 1).withColumnRenamed("_order", "_block")
    else:
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*keys, "_block", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values])
    starts = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_start"), *[F.col(v).alias(f"_s_{v}") for v in values]
    )
    # Null-safe, so that no filter is pushed into one of two equal subplans and
    # Spark can reuse the shuffle of the other.
    match = F.col("_block").eqNullSafe(F.col("_start"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    last = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    joined = blocked.join(starts, match)
    totals = {v: F.col(f"_s_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}
    return joined.select(*[totals[c].alias(c) if c in totals else F.col(c) for c in df.columns])
