"""What all learners share: fit on rows, predict rows, chain with transformers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidelearn.operators.routing import with_model
from tidelearn.params import Params

KEY = ["model_id"]


def need_columns(df: DataFrame, stage: object, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TypeError(f"{type(stage).__name__} needs column(s) {', '.join(missing)}; got {', '.join(df.columns)}")


def keyed(df: DataFrame) -> DataFrame:
    """Rows of a single problem get problem id 0."""
    return df if "model_id" in df.columns else with_model(df)


class Stage:
    """A step of a chain.  Subclasses give some of ``fit``, ``transform`` and ``predict``."""

    params: Params | None = None

    def with_params(self, **changes) -> "Stage":
        """A copy whose parameters are overridden for one call."""
        if not changes:
            return self
        if self.params is None:
            raise TypeError(f"{type(self).__name__} has no parameters")
        other = object.__new__(type(self))
        other.__dict__.update(self.__dict__)
        other.params = self.params.override(**changes)
        return other

    def fit(self, rows: DataFrame, **override) -> DataFrame | None:
        raise TypeError(f"{type(self).__name__} cannot be fitted on columns {', '.join(rows.columns)}")

    def transform(self, rows: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        raise TypeError(f"{type(self).__name__} cannot transform columns {', '.join(rows.columns)}")

    def predict(self, rows: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        raise TypeError(f"{type(self).__name__} cannot predict columns {', '.join(rows.columns)}")

    def no_parameters(self, override: dict) -> None:
        if override:
            raise TypeError(f"{type(self).__name__} has no parameter {', '.join(sorted(override))}")

    def chain(self, right: "Stage") -> "Chain":
        return Chain([self, right])


class Chain(Stage):
    """Transformers in order, ending in a transformer or a predictor.

    Call-time parameters are those of the last stage; an unknown name raises a ``TypeError``.

    Fitting trains the first stage, transforms the rows with it, and goes on
    with the next stage; the result is one model table per stage.
    """

    def __init__(self, stages: list[Stage]):
        flat: list[Stage] = []
        for stage in stages:
            flat.extend(stage.stages if isinstance(stage, Chain) else [stage])
        self.stages = flat

    def fit(self, rows: DataFrame, **override) -> list[DataFrame | None]:
        models: list[DataFrame | None] = []
        for i, stage in enumerate(self.stages):
            models.append(stage.fit(rows, **(override if i == len(self.stages) - 1 else {})))
            if i < len(self.stages) - 1:
                rows = stage.transform(rows, models[-1])
        return models

    def transform(self, rows: DataFrame, model=None, **override) -> DataFrame:
        models = model or [None] * len(self.stages)
        for stage, m in zip(self.stages[:-1], models[:-1]):
            rows = stage.transform(rows, m)
        return self.stages[-1].transform(rows, models[-1], **override)

    def predict(self, rows: DataFrame, model=None, **override) -> DataFrame:
        models = model or [None] * len(self.stages)
        for stage, m in zip(self.stages[:-1], models[:-1]):
            rows = stage.transform(rows, m)
        return self.stages[-1].predict(rows, models[-1], **override)


class Standardize(Stage):
    """Centre each feature and divide by its population standard deviation."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def fit(self, rows: DataFrame, **override) -> DataFrame:
        self.no_parameters(override)
        need_columns(rows, self, "features")
        x = F.col("features")
        d = range(self.dimension)
        return (
            keyed(rows)
            .groupBy(*KEY)
            .agg(
                F.array(*[F.avg(x[i]) for i in d]).alias("mean"),
                F.array(*[F.stddev_pop(x[i]) for i in d]).alias("scale"),
            )
        )

    def transform(self, rows: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        self.no_parameters(override)
        need_columns(rows, self, "features", "seq")
        if model is None:
            raise TypeError("Standardize must be fitted before it transforms")
        joined = keyed(rows).join(model, KEY)
        x, m, s = F.col("features"), F.col("mean"), F.col("scale")
        scaled = [
            F.when(s[i] > 0, (x[i] - m[i]) / F.nullif(s[i], F.lit(0.0))).otherwise(F.lit(0.0))
            for i in range(self.dimension)
        ]
        return joined.withColumn("features", F.array(*scaled)).drop("mean", "scale")


class RowFunction(Stage):
    """User function on vectors: ``fn(model, matrix) -> array``, one row in, one row out.

    ``model`` is any small picklable object; it travels with the task.  Arrow
    hands over whole batches, so ``fn`` sees a matrix and not single rows.
    """

    def __init__(self, fn: Callable, model: object = None, output: str = "prediction", returns: str = "double"):
        self.fn, self.model, self.output, self.returns = fn, model, output, returns

    def _apply(self, rows: DataFrame) -> DataFrame:
        need_columns(rows, self, "features")
        fn, model = self.fn, self.model

        def run(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            return pd.Series(list(fn(model, np.stack(x.to_numpy()))))

        udf = F.pandas_udf(run, self.returns)
        return rows.withColumn(self.output, udf("features"))

    def fit(self, rows: DataFrame, **override) -> None:
        self.no_parameters(override)

    def transform(self, rows: DataFrame, model=None, **override) -> DataFrame:
        self.no_parameters(override)
        return self._apply(rows)

    def predict(self, rows: DataFrame, model=None, **override) -> DataFrame:
        self.no_parameters(override)
        return self._apply(rows)
