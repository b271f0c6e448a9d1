"""Rows in an order, over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelearn.session import materialize


def in_order(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows in ranges sorted by ``by`` (nulls first), written with ``at``, which ascends in that order, and ``part``, the range.

    Ranges are about even whatever column is hot, as long as ``by`` tells most rows apart.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return materialize(placed.withColumn("part", F.expr("shiftright(at, 33)")), label)
