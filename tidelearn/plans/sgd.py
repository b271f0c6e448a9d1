"""Streaming lasso and ridge by gradient steps on each window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidelearn.functions.vectors import dot
from tidelearn.operators.moments import FLAT, moments, moments_long, pack, pack_long, unpack_np
from tidelearn.operators.routing import sound, unlabel
from tidelearn.operators.windows import labelled_windows
from tidelearn.params import SgdParams
from tidelearn.plans.learner import KEY, Stage, keyed, need_columns
from tidelearn.session import materialize, new_path
from tidelearn.streaming.store import ModelStore

# Moments that one task may hold while it steps through a model's windows, before the state is written.
HELD_CELLS = 4_000_000


def descend(w: np.ndarray, gram: np.ndarray, r: np.ndarray, n: float, p: SgdParams) -> np.ndarray:
    """``iterations`` full-window steps with rate ``step / sqrt(i)``.

    The squared-loss gradient needs only the window's moments, so the rows are
    read once however many steps are taken.
    """
    for i in range(1, p.iterations + 1):
        rate = p.step / np.sqrt(i)
        w_next = w - rate * (gram @ w - r) / n
        if p.penalty == "l1":
            w = np.sign(w_next) * np.maximum(np.abs(w_next) - rate * p.reg, 0.0)
        else:
            w = w_next - rate * p.reg * w
    return w


class SgdRegression(Stage):
    """Linear least squares with an L1 threshold or an L2 shrink after each step."""

    def __init__(self, params: SgdParams = SgdParams()):
        self.params = params

    def rejects(self, rows: DataFrame) -> DataFrame:
        """Rows of another width, with nulls or NaN, or without an order key: they neither train nor are scored."""
        return sound(rows, self.params.dimension)[1]

    def window_moments(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        d = self.params.dimension
        if d <= FLAT:
            return pack(moments(rows, d, keys), d, keys)
        return pack_long(moments_long(rows, d, keys), d, keys)

    def _walk(self, sums: DataFrame, state: DataFrame | None) -> DataFrame:
        """Step through the given windows of each model in order."""
        p = self.params
        start = F.array_repeat(F.lit(0.0), p.dimension)
        if state is None:
            lined = sums.withColumn("_w", start).withColumn("_n", F.lit(0).cast("long"))
        else:
            old = state.select(*KEY, F.col("weights").alias("_w"), F.col("n").alias("_n"))
            lined = sums.join(old, KEY, "left")
            lined = lined.withColumn("_w", F.coalesce("_w", start)).withColumn("_n", F.coalesce("_n", F.lit(0)))
        kind = dict(sums.dtypes)["model_id"]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("version")
            w, n = np.array(pdf["_w"].iloc[0], dtype=float), int(pdf["_n"].iloc[0])
            grams = unpack_np(np.stack(pdf["xx"].to_numpy()), p.dimension)
            out = []
            for gram, xy, m in zip(grams, pdf["xy"], pdf["n"]):
                if m > 0:
                    w = descend(w, gram, np.asarray(xy), float(m), p)
                n += int(m)
                out.append((n, w))
            return pd.DataFrame(
                {
                    "model_id": pdf["model_id"].to_numpy(),
                    "version": pdf["version"].to_numpy(),
                    "n": [o[0] for o in out],
                    "weights": [o[1] for o in out],
                }
            )

        return lined.groupBy(*KEY).applyInPandas(run, f"model_id {kind}, version long, n long, weights array<double>")

    def fit(self, rows: DataFrame, **override) -> DataFrame:
        """All versions; one distributed job for the moments, then a walk over windows."""
        me = self.with_params(**override)
        need_columns(rows, me, "seq", "label", "features")
        rows = unlabel(sound(keyed(rows), me.params.dimension)[0], me.params.sentinel)
        windows = labelled_windows(rows, me.params.window, keys=KEY, name="version").filter("label is not null")
        sums = materialize(me.window_moments(windows, [*KEY, "version"]), "sgd-moments")
        last = sums.agg(F.max("version")).first()[0]
        if last is None:
            raise ValueError("no rows to fit")
        step = max(1, HELD_CELLS // me.params.dimension**2)
        if last < step:
            return me._walk(sums, None)
        # Versions of each pass are written; only the newest of each model goes on to the next.
        store, state = ModelStore(rows.sparkSession, new_path(rows.sparkSession, "sgd-models")), None
        for k, first in enumerate(range(0, last + 1, step)):
            part = me._walk(sums.filter(F.col("version").between(first, first + step - 1)), state)
            store.write(part.withColumnRenamed("version", "window_id"), k)
            part = store.read(k).withColumnRenamed("window_id", "at").select(*KEY, "at", "n", "weights")
            if state is not None:
                part = part.unionByName(state.select(*KEY, F.lit(-1).cast("long").alias("at"), "n", "weights"))
            newest = part.groupBy(*KEY).agg(F.max_by(F.struct("n", "weights"), "at").alias("s")).select(*KEY, "s.*")
            state = materialize(newest, "sgd-state")
        return store.all().select(*KEY, F.col("window_id").alias("version"), "n", "weights")

    def update(self, batch: DataFrame, state: DataFrame | None) -> DataFrame:
        batch = sound(batch, self.params.dimension)[0]
        sums = self.window_moments(batch, KEY).withColumn("version", F.lit(0).cast("long"))
        moved = self._walk(sums, state).drop("version")
        if state is None:
            return moved
        rest = state.select(*moved.columns).join(moved.select(*KEY), KEY, "left_anti")
        return moved.unionByName(rest)

    def ready(self, state: DataFrame) -> DataFrame:
        return state

    def score(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        joined = rows.join(state.select(*KEY, "weights"), KEY)
        return joined.withColumn("prediction", dot(F.col("features"), F.col("weights"), self.params.dimension)).drop(
            "weights"
        )

    def predict(self, rows: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        """Score rows with the newest version of each model."""
        newest = model.groupBy(*KEY).agg(F.max_by("weights", "version").alias("weights"))
        return self.score(keyed(rows), newest)
