"""Count windows of exactly W rows on a stream, per model and shard.

Each shard stands for one independent worker: it closes a window whenever W
labelled rows have arrived.  Its state is the open window's moments and not
its rows, so the state has a fixed size and no key holds a growing group.  The open
window is closed early where nothing has arrived for ``idle`` milliseconds, and at the end of the stream
it is read from the state, so no row is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidelearn.operators.routing import shard_of

STATE = "window_id long, n long, xx array<double>, xy array<double>"
COLUMNS = ["model_id", "shard", "window_id", "n", "xx", "xy"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CountWindows(StatefulProcessor):
    """Adds rows to the open window of their key and hands on each window that is full, or idle too long."""

    def __init__(self, size: int, d: int, idle: int | None = None):
        self.size, self.d, self.idle = size, d, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _empty(self, window_id: int) -> tuple:
        return window_id, 0, np.zeros(self.d * (self.d + 1) // 2), np.zeros(self.d)

    def _keep(self, state: tuple) -> None:
        self.open.update((state[0], state[1], state[2].tolist(), state[3].tolist()))

    def _wait(self, now: int) -> None:
        """One timer per key, ``idle`` after its last rows."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(self.d)
        if self.open.exists():
            window_id, n, xx, xy = self.open.get()
            state = window_id, n, np.array(xx), np.array(xy)
        else:
            state = self._empty(0)
        closed = []
        for pdf in rows:
            x, y = np.stack(pdf["features"].to_numpy()), pdf["label"].to_numpy()
            at = 0
            while at < len(y):
                window_id, n, xx, xy = state
                take = min(self.size - n, len(y) - at)
                part = x[at : at + take]
                state = window_id, n + take, xx + (part.T @ part)[upper], xy + part.T @ y[at : at + take]
                at += take
                if state[1] == self.size:
                    closed.append((*key, *state))
                    state = self._empty(window_id + 1)
        self._keep(state)
        if self.idle is not None:
            self._wait(timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(closed, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = []
        if self.open.exists():
            state = self.open.get()
            if state[1]:
                closed.append((*key, *state))
                self._keep(self._empty(state[0] + 1))
        yield pd.DataFrame(closed, columns=COLUMNS)

    def close(self) -> None:
        pass


def exact_windows(stream: DataFrame, size: int, d: int, shards: int, by: Column | None = None, idle: int | None = None) -> DataFrame:
    """Closed windows ``(model_id, shard, window_id, n, xx, xy)`` of labelled rows in arrival order.

    With ``idle`` (milliseconds) an open window closes early when its worker gets no rows for that long; such a query
    runs until it is stopped.  Without, use :func:`open_windows` at the end.
    """
    kind = dict(stream.dtypes)["model_id"]
    labelled = stream.filter(F.col("label").isNotNull()).withColumn("shard", shard_of(shards, by=by))
    return (
        labelled.select("model_id", "shard", F.col("label").cast("double").alias("label"), "features")
        .groupBy("model_id", "shard")
        .transformWithStateInPandas(
            CountWindows(size, d, idle), f"model_id {kind}, shard int, {STATE}", "append", "none" if idle is None else "processingTime"
        )
    )


def start_windows(windows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts a query on :func:`exact_windows`; ``every`` is the trigger of one that goes on, without it what is there is read."""
    spark = windows.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # keyed state with lists and timers; a query keeps the setting it starts with
    try:
        writer = windows.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(PROVIDER, before)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that are open in the state of a stopped query, in the form of the closed ones."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return state.select("key.*", "value.*").where("n > 0").select(*COLUMNS)
