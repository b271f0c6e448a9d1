"""Ridge models per event-time window.

Moments add up, so a late row only adds to its window; a watermark bounds how
long a window stays open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelearn.operators.moments import moments, pack
from tidelearn.plans.moment_learners import Ridge


def window_moments(
    rows: DataFrame, d: int, every: str, keys: list[str], ts: str = "ts", late: str | None = None
) -> DataFrame:
    """Moments per time window and key, for bounded and streaming rows."""
    if late:
        rows = rows.withWatermark(ts, late)
    timed = rows.withColumn("window", F.window(ts, every))
    return moments(timed, d, ["window", *keys])


def window_models(sums: DataFrame, learner: Ridge, keys: list[str]) -> DataFrame:
    """One solved model per time window and key."""
    d = learner.params.dimension
    packed = pack(sums, d, ["window", *keys])
    return packed.select("window", *keys, F.col("n").cast("long").alias("n"), learner.weights().alias("weights"))
