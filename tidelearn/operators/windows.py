"""Count windows over a unique integer order key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidelearn.operators.prefix import running_total
from tidelearn.session import materialize

# Order keys are cut into ranges of this width.  A unique integer key puts at
# most this many rows of one key into one range.
RANGE = 1 << 17
# Up to so many ranges are summed in one go, more of them in blocks.
FEW = 1 << 16


def number_rows(
    df: DataFrame,
    order: str = "seq",
    keys: list[str] | None = None,
    counted: str | None = None,
    width: int = RANGE,
    name: str = "position",
) -> DataFrame:
    """Zero-based position of each row along ``order`` within ``keys``.

    A plain ``row_number`` would sort a whole key in one task.  Here each range
    of the order key is sorted on its own and starts at the number of rows in
    the ranges before it.  With ``counted`` (a boolean column) a row's position
    is the number of counted rows before it.  ``order`` and ``keys`` must not
    be null.  The table of ranges is written once, and how it is summed depends on its size.
    """
    keys = keys or []
    cut = F.expr(f"cast(`{order}` as bigint) div {width}L")
    unit = F.col(counted).cast("long") if counted else F.lit(1).cast("long")
    ranged = df.withColumn("_range", cut).withColumn("_unit", unit)
    lowest = materialize(ranged.groupBy(*keys, "_range").agg(F.sum("_unit").alias("_first")), "ranges")
    few = lowest.limit(FEW + 1).count() <= FEW
    starts = running_total(lowest, keys, "_range", ["_first"], inclusive=False, **({"levels": 0} if few else {})).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_at"), "_first"
    )
    match = F.col("_range") == F.col("_at")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    position = F.col("_first") + F.coalesce(F.sum("_unit").over(inside), F.lit(0))
    return ranged.join(starts, match).select(*df.columns, position.alias(name))


def count_windows(
    df: DataFrame,
    size: int,
    order: str = "seq",
    keys: list[str] | None = None,
    counted: str | None = None,
    width: int = RANGE,
    name: str = "window_id",
) -> DataFrame:
    """Add the number of the count window of ``size`` rows each row falls in."""
    numbered = number_rows(df, order, keys, counted, width, "_position")
    return numbered.withColumn(name, F.expr(f"`_position` div {size}L")).drop("_position")


def drop_tail(df: DataFrame, size: int, keys: list[str] | None = None, name: str = "window_id") -> DataFrame:
    """Keep full windows only: the behaviour without a flush at end of stream."""
    keys = keys or []
    full = df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= size)
    return df.join(full.drop("_n"), [*keys, name], "left_semi")


def labelled_windows(
    df: DataFrame, size: int, order: str = "seq", keys: list[str] | None = None, label: str = "label", name: str = "window_id"
) -> DataFrame:
    """Count windows of ``size`` labelled rows.

    Only labelled rows fill a window.  A row without a label falls into the window that is open when
    it arrives, so the windows before its own are complete; the tail may open one more window, which holds no label.
    """
    marked = df.withColumn("_labelled", F.col(label).isNotNull())
    return count_windows(marked, size, order, keys, "_labelled", name=name).drop("_labelled")


def occurrences(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Number the rows of each key value from 0 in an order, however many rows share a value.

    Rows are cut into ranges of (keys, order), sorted where they are and written; a row's number is its place in
    its range after the rows of its value in the ranges before.  Nulls are one value and come first; rows that agree in all of ``order`` are numbered as they come.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_part", F.expr("shiftright(_row, 33)")), "occurrences")
    counts = placed.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_of"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    match = F.col("_part") == F.col("_of")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(starts, match).select(*df.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias(name))
