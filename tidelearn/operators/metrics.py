"""Evaluation of predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelearn.operators.hinge import signed
from tidelearn.operators.windows import occurrences


def join_truth(pred: DataFrame, truth: DataFrame, on: str = "seq") -> DataFrame:
    """Every prediction with its truth, joined on the order key."""
    return pred.join(truth, on, "left")


def duplicate_keys(truth: DataFrame, on: str) -> DataFrame:
    """Key values that a value-keyed truth join would match more than once."""
    return truth.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def bag_join(pred: DataFrame, truth: DataFrame, on: str, pred_order: list[str], truth_order: list[str]) -> DataFrame:
    """Predictions and truth that share a value, one to one: the k-th prediction of a value meets its k-th truth.

    A value key names no single row, so a plain join would pair every prediction of a value with every truth of it.  Rows without a partner
    stay with nulls on the other side (``side`` is ``both``, ``pred`` or ``truth``); columns other than ``on`` must differ in name.
    """
    left = occurrences(pred, [on], pred_order).withColumnRenamed(on, "_value").withColumn("_p", F.lit(True))
    right = occurrences(truth, [on], truth_order).withColumnRenamed("occurrence", "_k").withColumn("_t", F.lit(True))
    match = F.col("_value").eqNullSafe(F.col(on)) & (F.col("occurrence") == F.col("_k"))
    both = left.join(right, match, "full")
    side = F.when(F.col("_p").isNull(), "truth").when(F.col("_t").isNull(), "pred").otherwise("both")
    value = F.when(F.col("_t").isNull(), F.col("_value")).otherwise(F.col(on))
    rest = [c for c in (*pred.columns, *truth.columns) if c != on]
    return both.select(value.alias(on), F.coalesce("occurrence", "_k").alias("occurrence"), side.alias("side"), *rest)


def accuracy(joined: DataFrame, prediction: Column | None = None, truth: Column | None = None) -> DataFrame:
    """Row count, right predictions and their ratio; both sides coded as -1/+1 first."""
    p = signed(prediction if prediction is not None else F.col("prediction"))
    t = signed(truth if truth is not None else F.col("truth"))
    right = F.count_if(p == t)
    n = F.count(F.lit(1))
    return joined.agg(
        n.alias("n"), right.alias("n_right"), (right.cast("double") / F.nullif(n, F.lit(0))).alias("accuracy")
    )


def regression_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean squared error and the share of explained variance."""
    y, p = F.col(label), F.col(prediction)
    mse = F.avg((y - p) * (y - p))
    spread = F.var_pop(y)
    return rows.agg(mse.alias("mse"), (1.0 - mse / F.nullif(spread, F.lit(0.0))).alias("r2"))


def coef_error(models: DataFrame, true: list[float], keys: list[str], weights: str = "weights") -> DataFrame:
    """Mean absolute difference between fitted and true coefficients."""
    truth = F.array(*[F.lit(float(c)) for c in true])
    gaps = F.zip_with(F.col(weights), truth, lambda a, b: F.abs(a - b))
    return models.select(*keys, (F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / len(true)).alias("err"))
