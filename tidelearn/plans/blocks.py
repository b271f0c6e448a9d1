"""Runs of small windows in one job.

A window depends on the model of the window before it, so a model's windows cannot run side by side.  A window
that fills the cluster is a job of its own; smaller ones go by blocks: one job for some windows of all models, in which a model's rows of the
block, a bounded number, are sorted and walked through by one task.  Models run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelearn.session import tasks

#: Rows of a model that a block holds at most; windows of more than half of it are jobs of their own.
BLOCK_ROWS = 1 << 19
#: Versions that a task hands over at a time.
VERSIONS = 256


def span(window: int, most: int) -> int:
    """Windows of a block, 1 where a window is a job of its own."""
    return max(1, most // max(1, window))


def walk(
    rows: DataFrame, state: DataFrame | None, unit: str, low: int, high: int, models: int,
    start: Callable[[], dict], step: Callable[[dict, pa.Table], dict], schema: str,
) -> DataFrame:
    """Versions ``low`` to ``high`` of all models, as ``schema`` (``model_id`` first) and ``version``.

    ``rows`` are those of the units ``low`` to ``high``, ``state`` the models before them.  ``step`` moves a model through the rows of one unit; a model
    without rows in a unit stays as it is.
    """
    named = f"{schema}, version bigint"
    arrow = to_arrow_schema(StructType.fromDDL(named))
    names = [f.name for f in StructType.fromDDL(schema).fields if f.name != "model_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, parts, model, out = None, None, [], None, []

        def stay(until: int) -> None:
            """The model's versions before ``until`` that are not told yet."""
            nonlocal told
            for v in range(told, until):
                if model is not None:
                    out.append({"model_id": key, **model, "version": v})
            told = max(told, until)

        def close() -> None:
            nonlocal model
            held = pa.Table.from_batches(parts)
            if at < low:
                (row,) = held.select([f"_{n}" for n in names]).to_pylist()
                model = {n: row[f"_{n}"] for n in names}
                return
            stay(at)
            model = step(start() if model is None else model, held)
            stay(at + 1)

        told = low
        for batch in batches:
            units = batch.column(1).to_numpy()
            codes = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((np.diff(codes) != 0) | (np.diff(units) != 0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if a == b:
                    continue
                own, now = batch.column(0)[a].as_py(), int(units[a])
                if parts and (own != key or now != at):
                    close()
                    parts = []
                    if own != key:
                        stay(high + 1)
                        model, told = None, low
                    if len(out) >= VERSIONS:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                key, at = own, now
                parts.append(batch.slice(a, b - a))
        if parts:
            close()
            stay(high + 1)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    lined = rows.withColumn(unit, F.col(unit).cast("long")).select("model_id", unit, *[c for c in rows.columns if c not in ("model_id", unit)])
    if state is not None:
        before = state.select("model_id", F.lit(low - 1).cast("long").alias(unit), *[F.col(n).alias(f"_{n}") for n in names])
        lined = lined.unionByName(before, allowMissingColumns=True)
        # Null lists take square time on their way into Arrow batches, empty ones do not.
        lined = lined.withColumns({n: F.coalesce(n, F.array().cast(t)) for n, t in lined.dtypes if t.startswith("array")})
    placed = lined.repartition(max(1, min(models, tasks(rows.sparkSession))), "model_id").sortWithinPartitions("model_id", unit)
    return placed.mapInArrow(run, named)


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors of ``d`` numbers as rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
