"""Ridge regression and shrinkage lasso on running moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidelearn.functions.vectors import dot
from tidelearn.operators.moments import FLAT, cell_names, moments, moments_long, pack, pack_long, prefix_moments, unpack_np
from tidelearn.operators.routing import sound, split_labelled, unlabel
from tidelearn.operators.windows import labelled_windows
from tidelearn.params import LassoParams, RidgeParams
from tidelearn.plans.learner import KEY, Stage, keyed, need_columns


class MomentLearner(Stage):
    """A linear model solved from ``sum x x'`` and ``sum y x``.

    Moments add up, so the models of all windows come from one job without a
    loop: a sum per window, a running total, and one small solve per version.
    """

    def solver(self):
        raise NotImplementedError

    def windowed(self, rows: DataFrame) -> DataFrame:
        """Sound rows with null for hidden labels and their window of labelled rows; ``rejects`` has the others."""
        need_columns(rows, self, "seq", "label", "features")
        p = self.params
        return labelled_windows(unlabel(sound(keyed(rows), p.dimension)[0], p.sentinel), p.window, keys=KEY)

    def rejects(self, rows: DataFrame) -> DataFrame:
        """Rows of another width, with nulls or NaN, or without an order key: they neither train nor are scored."""
        return sound(rows, self.params.dimension)[1]

    def fit(self, rows: DataFrame, **override) -> DataFrame:
        """All model versions ``(model_id, version, n, weights)``; version t includes window t."""
        me = self.with_params(**override)
        return me.fit_windows(me.windowed(rows))

    def fit_windows(self, rows: DataFrame, order: str = "window_id") -> DataFrame:
        total = prefix_moments(rows.filter("label is not null"), self.params.dimension, KEY, order)
        return total.select(
            *KEY, F.col(order).alias("version"), F.col("n").cast("long").alias("n"), self.weights().alias("weights")
        )

    def weights(self) -> Column:
        return self.solver()("xx", "xy", "n")

    def fit_groups(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """One model per key over all rows of the key, without windows."""
        d = self.params.dimension
        packed = (
            pack(moments(rows, d, keys), d, keys) if d <= FLAT else pack_long(moments_long(rows, d, keys), d, keys)
        )
        return packed.select(*keys, F.col("n").cast("long").alias("n"), self.weights().alias("weights"))

    def predict(self, rows: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        """Score unlabelled rows of a bounded table with the model of their time.

        A row in window t uses version t-1, or the first later version that is
        warm.  The count never falls, so the first warm version is one number
        per model and the as-of join becomes an equi-join.  All rows up to the first warm version share it: they
        get it with their model's record and do not meet on one version key.  Rows of a
        model that never warms up have a null version and prediction.
        """
        me = self.with_params(**override)
        return me.predict_windows(me.windowed(rows), model)

    def predict_windows(self, rows: DataFrame, versions: DataFrame) -> DataFrame:
        d = self.params.dimension
        _, waiting = split_labelled(rows)
        warm = versions.filter(F.col("n") > self.params.warmup)
        first = warm.groupBy(*KEY).agg(F.min("version").alias("_first"), F.min_by("weights", "version").alias("_weights"))
        placed = waiting.join(first, KEY, "left")
        late = F.col("window_id") - 1 > F.col("_first")
        early = placed.filter(~F.coalesce(late, F.lit(False))).withColumn("version", F.col("_first")).withColumnRenamed("_weights", "weights")
        later = placed.filter(late).drop("_weights").withColumn("version", F.col("window_id") - 1)
        later = later.join(versions.select(*KEY, "version", "weights"), [*KEY, "version"])
        scored = early.unionByName(later)
        return scored.withColumn("prediction", dot(F.col("features"), F.col("weights"), d)).drop("weights", "_first")

    # One micro-batch at a time: the state is the moment sums per model.

    def update(self, batch: DataFrame, state: DataFrame | None) -> DataFrame:
        d = self.params.dimension
        batch = sound(batch, d)[0]
        if d <= FLAT:
            cells = moments(batch, d, KEY)
            if state is not None:
                names = ["n", *cell_names(d)]
                both = cells.unionByName(state.select(*KEY, *names))
                cells = both.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in names])
            packed = pack(cells, d, [*KEY, *cell_names(d)])
        else:
            cells = moments_long(batch, d, KEY)
            if state is not None:
                both = cells.unionByName(state.select(*KEY, F.explode("cells").alias("c")).select(*KEY, "c.*"))
                cells = both.groupBy(*KEY, "i", "j").agg(F.sum("g").alias("g"))
            kept = cells.groupBy(*KEY).agg(F.collect_list(F.struct("i", "j", "g")).alias("cells"))
            packed = pack_long(cells, d, KEY).join(kept, KEY)
        return packed.withColumn("weights", self.weights()).drop("xx", "xy")

    def ready(self, state: DataFrame) -> DataFrame:
        return state.filter(F.col("n") > self.params.warmup)

    def score(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """Score rows with one given state."""
        joined = rows.join(state.select(*KEY, "weights"), KEY)
        return joined.withColumn("prediction", dot(F.col("features"), F.col("weights"), self.params.dimension)).drop("weights")


class Ridge(MomentLearner):
    """``(lambda I + sum x x') w = sum y x``."""

    def __init__(self, params: RidgeParams = RidgeParams()):
        self.params = params

    def solver(self):
        d, penalty = self.params.dimension, self.params.penalty

        @F.pandas_udf("array<double>")
        def solve(xx: pd.Series, xy: pd.Series, n: pd.Series) -> pd.Series:
            if len(xx) == 0:
                return pd.Series([], dtype=object)
            a = unpack_np(np.stack(xx.to_numpy()), d) + penalty * np.eye(d)
            w = np.linalg.solve(a, np.stack(xy.to_numpy())[:, :, None])[:, :, 0]
            return pd.Series(list(w))

        return solve


def shrink(gram: np.ndarray, r: np.ndarray, penalty: float, passes: int, tolerance: float, zero_below: float):
    """Fixed point of the shrinkage iteration for a stack of problems.

    ``beta <- B^(1/2) (B^(1/2) G B^(1/2) + lambda I)^(-1) B^(1/2) r`` with
    ``B = diag(|beta|)``, from all ones; each problem stops on its own.
    """
    beta = np.ones_like(r)
    live = np.arange(len(r))
    eye = np.eye(r.shape[1])
    for _ in range(passes):
        if len(live) == 0:
            break
        root = np.sqrt(np.abs(beta[live]))
        inner = root[:, :, None] * gram[live] * root[:, None, :] + penalty * eye
        new = root * np.linalg.solve(inner, (root * r[live])[:, :, None])[:, :, 0]
        moved = np.abs(new - beta[live]).max(axis=1)
        beta[live] = new
        live = live[moved >= tolerance]
    beta[np.abs(beta) < zero_below] = 0.0
    return beta


class ShrinkageLasso(MomentLearner):
    """Lasso ``0.5 ||y - X b||^2 + lambda ||b||_1`` by repeated shrinkage."""

    def __init__(self, params: LassoParams = LassoParams()):
        self.params = params

    def solver(self):
        p = self.params

        @F.pandas_udf("array<double>")
        def solve(xx: pd.Series, xy: pd.Series, n: pd.Series) -> pd.Series:
            if len(xx) == 0:
                return pd.Series([], dtype=object)
            gram = unpack_np(np.stack(xx.to_numpy()), p.dimension)
            r = np.stack(xy.to_numpy())
            return pd.Series(list(shrink(gram, r, p.penalty, p.passes, p.tolerance, p.zero_below)))

        return solve
