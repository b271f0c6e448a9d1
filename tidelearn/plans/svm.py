"""Online linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelearn.functions.vectors import UNROLL
from tidelearn.operators.hinge import decision, hinge_columns, hinge_sums, sign_of, svm_step
from tidelearn.operators.moments import merge_by_count
from tidelearn.operators.routing import sound, split_labelled, unlabel
from tidelearn.operators.windows import labelled_windows
from tidelearn.params import SvmParams
from tidelearn.plans import blocks
from tidelearn.plans.learner import KEY, Stage, keyed, need_columns
from tidelearn.session import materialize, new_path
from tidelearn.streaming.store import ModelStore

# Tasks that write a bucket's rows, at most, and windows or rounds of a bucket: folders do not grow with the windows.
WINDOW_FILES = 16
BUCKET = 64
STATE = [*KEY, "n", "weights", "intercept"]


def _points(part, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and signs of a window's rows."""
    return blocks.matrix(part.column("features"), d), np.where(part.column("label").to_numpy() > 0, 1.0, -1.0)


class OnlineSvm(Stage):
    """One gradient step per window, merged into the model by row count.

    A window depends on the model of the window before it, so windows run one
    after the other.  A large window is one distributed aggregate over all models, small ones go by blocks
    (:mod:`tidelearn.plans.blocks`); :meth:`fit_sharded` trains shards side by side.
    """

    def __init__(self, params: SvmParams = SvmParams()):
        self.params = params

    def _with_state(self, rows: DataFrame, state: DataFrame | None, start: dict | None = None) -> DataFrame:
        start = start or self._start()
        if state is None:
            return rows.withColumns(start)
        joined = rows.join(state.select(*STATE), KEY, "left")
        return joined.withColumns({c: F.coalesce(F.col(c), first) for c, first in start.items()})

    def _start(self) -> dict[str, Column]:
        p = self.params
        return {
            "n": F.lit(0).cast("long"),
            "weights": F.array_repeat(F.lit(p.start_weight), p.dimension),
            "intercept": F.lit(p.start_intercept),
        }

    def columns(self) -> dict:
        """The column expressions of one step, built once and used for every window."""
        p = self.params
        step = svm_step(cost=p.cost, step=p.step, step_intercept=p.step_intercept, merge=p.merge)
        # Every row of a model carries the same state, so any row's copy will do.
        old = [
            F.any_value("n").alias("n"),
            F.array(*[F.any_value(F.col("weights")[i]) for i in range(p.dimension)]).alias("weights"),
            F.any_value("intercept").alias("intercept"),
        ]
        return {"start": self._start(), "sums": hinge_columns(p.dimension), "old": old, "step": step}

    def advance(self, batch: DataFrame, state: DataFrame | None, columns: dict | None = None) -> DataFrame:
        """The new state of the models that have rows in this window."""
        columns = columns or self.columns()
        d = self.params.dimension
        rows = self._with_state(batch, state, columns["start"])
        if d <= UNROLL:
            joined = rows.groupBy(*KEY).agg(*columns["sums"], *columns["old"])
        else:
            first = columns["start"]
            joined = hinge_sums(rows, KEY, d, columns["sums"])
            if state is None:
                joined = joined.withColumns(first)
            else:
                joined = joined.join(state.select(*STATE), KEY, "left")
                joined = joined.withColumns({c: F.coalesce(F.col(c), start) for c, start in first.items()})
        w, b, n = columns["step"]
        # New names first: an alias equal to an input would be picked up inside the lambda.
        return joined.select(*KEY, n.alias("_n"), w.alias("_w"), b.alias("_b")).toDF(*STATE)

    def update(self, batch: DataFrame, state: DataFrame | None, columns: dict | None = None) -> DataFrame:
        """The state after one window; models without rows keep theirs."""
        batch = sound(batch, self.params.dimension)[0]
        moved = self.advance(batch, state, columns)
        if state is None:
            return moved
        idle = state.select(*STATE).join(batch.select(*KEY).distinct(), KEY, "left_anti")
        return moved.unionByName(idle)

    def windowed(self, rows: DataFrame) -> DataFrame:
        need_columns(rows, self, "seq", "label", "features")
        return labelled_windows(unlabel(sound(keyed(rows), self.params.dimension)[0], self.params.sentinel), self.params.window, keys=KEY)

    def rejects(self, rows: DataFrame) -> DataFrame:
        """Rows of another width, with nulls or NaN, or without an order key: they neither train nor are scored."""
        return sound(rows, self.params.dimension)[1]

    def fit(self, rows: DataFrame, **override) -> DataFrame:
        """All versions ``(model_id, version, n, weights, intercept)``."""
        me = self.with_params(**override)
        spark = rows.sparkSession
        spread = F.pmod(F.xxhash64("seq"), F.lit(WINDOW_FILES))
        span = blocks.span(me.params.window, blocks.BLOCK_ROWS)
        bucket = span if span > 1 else BUCKET
        labelled = me.windowed(rows).filter("label is not null").withColumn("bucket", F.expr(f"window_id div {bucket}"))
        windows = materialize(labelled.repartition("bucket", spread).sortWithinPartitions("bucket", "window_id"), "svm-windows", ["bucket"])
        last = windows.agg(F.max("window_id")).first()[0]
        if last is None:
            raise ValueError("no rows to fit")
        columns, state = me.columns(), None
        store = ModelStore(spark, new_path(spark, "svm-models"))
        if span > 1:
            return me._by_blocks(windows, "window_id", span, last, me._window_step(), store)
        for t in range(last + 1):
            window = windows.filter((F.col("bucket") == t // BUCKET) & (F.col("window_id") == t)).drop("bucket")
            store.write(me.update(window, state, columns), t)
            state = store.read(t)
        return store.all()

    def _by_blocks(self, rows: DataFrame, unit: str, span: int, last: int, step, store: ModelStore) -> DataFrame:
        """All versions; ``rows`` lie by ``bucket``, the number of their block."""
        p = self.params
        kind, d = dict(rows.dtypes)["model_id"], p.dimension
        first = {"n": 0, "weights": [p.start_weight] * d, "intercept": p.start_intercept}
        state, models = None, rows.select(*KEY).distinct().count()
        for low in range(0, last + 1, span):
            high = min(low + span - 1, last)
            block = rows.filter(F.col("bucket") == low // span).drop("bucket")
            schema = f"model_id {kind}, n bigint, weights array<double>, intercept double"
            store.write_run(blocks.walk(block, state, unit, low, high, models, lambda: dict(first), step, schema), low, high)
            state = store.read(high)
        return store.all()

    def _window_step(self):
        """One window of one model, as :meth:`advance`."""
        p = self.params

        def step(model: dict, part) -> dict:
            x, y = _points(part, p.dimension)
            w, b, m = np.array(model["weights"]), model["intercept"], len(y)
            hit = y * (x @ w + b) < 1.0
            total = model["n"] + m
            share = m / total if p.merge == "count" else 1.0
            w = w - p.step * share * (w - p.cost / m * (y[hit] @ x[hit]))
            b = b + p.step_intercept * share * p.cost / m * float(y[hit].sum())
            return {"n": total, "weights": w.tolist(), "intercept": b}

        return step

    def _round_step(self, steps: int):
        """One round of one model: its shards side by side, as :meth:`local_models` and :meth:`merge_shards`."""
        p = self.params

        def step(model: dict, part) -> dict:
            x, y = _points(part, p.dimension)
            window = part.column("window_id").to_numpy()
            shards, shard = np.unique(window // steps, return_inverse=True)
            w, b = np.tile(model["weights"], (len(shards), 1)), np.full(len(shards), model["intercept"])
            n = np.zeros(len(shards))
            for k in range(steps):
                own = np.flatnonzero(window % steps == k)
                at, xs, ys = shard[own], x[own], y[own]
                hit = ys * ((xs * w[at]).sum(axis=1) + b[at]) < 1.0
                m = np.bincount(at, minlength=len(shards)).astype(float)
                some = m > 0
                pull = np.column_stack([np.bincount(at[hit], (ys * v)[hit], len(shards)) for v in (*xs.T, np.ones(len(ys)))])[some]
                rate = (m / np.maximum(n + m, 1) if p.merge == "count" else np.ones(len(shards)))[some]
                part_of = (p.cost / m[some])[:, None] * pull
                w[some] -= p.step * rate[:, None] * (w[some] - part_of[:, :-1])
                b[some] += p.step_intercept * rate * part_of[:, -1]
                n += m
            total = model["n"] + int(n.sum())
            merged = (model["n"] * np.array([*model["weights"], model["intercept"]]) + n @ np.column_stack([w, b])) / total
            return {"n": total, "weights": merged[:-1].tolist(), "intercept": float(merged[-1])}

        return step

    def fit_sharded(self, rows: DataFrame, steps: int = 1, **override) -> DataFrame:
        """Local training per shard on a model that is one round old, shard models merged by count after each round.

        A round is ``shards * steps`` windows of labelled rows: shard s takes the ``steps`` windows that begin with window
        ``round * shards * steps + s * steps``, one after the other, all from the model that the round before left.  So staleness is bounded, a
        round has the same windows however long the table is, and a longer table keeps its first versions.  A task holds the
        gradient of one window; choose ``shards`` to fill the cluster, whatever the number of models.
        """
        me = self.with_params(**override)
        p, spark = me.params, rows.sparkSession
        numbered = me.windowed(rows).filter("label is not null")
        placed = numbered.select(
            *KEY, "seq", "label", "features", "window_id",
            F.expr(f"window_id div {int(steps)}").alias("shard"), F.expr(f"window_id div {int(steps) * p.shards}").alias("round"),
        )
        # Rounds lie in order inside buckets of rounds, so a round reads the row groups of one folder.
        span = blocks.span(p.window * p.shards * int(steps), blocks.BLOCK_ROWS)
        bucketed = placed.withColumn("bucket", F.expr(f"round div {span if span > 1 else BUCKET}"))
        spread = F.pmod(F.xxhash64("seq"), F.lit(WINDOW_FILES))
        table = materialize(bucketed.repartition("bucket", spread).sortWithinPartitions("bucket", "round"), "svm-shards", ["bucket"])
        last = table.agg(F.max("round")).first()[0]
        if last is None:
            raise ValueError("no rows to fit")
        store = ModelStore(spark, new_path(spark, "svm-sharded"))
        if span > 1:
            return me._by_blocks(table.drop("shard"), "round", span, last, me._round_step(int(steps)), store)
        state = None
        for r in range(last + 1):
            batch = table.filter((F.col("bucket") == r // BUCKET) & (F.col("round") == r)).drop("round", "bucket")
            store.write(me.merge_shards(me.local_models(batch, state), state), r)
            state = store.read(r)
        return store.all()

    def local_models(self, rows: DataFrame, state: DataFrame | None) -> DataFrame:
        """One model per ``(model_id, shard)`` after that shard's local windows.

        Rows arrive sorted, so a task walks through its shards with one model and the sums of one window in memory.
        """
        p = self.params
        lined = self._with_state(rows, state).select(*KEY, "shard", "window_id", "seq", "label", "features", "weights", "intercept")
        placed = lined.repartition(*KEY, "shard").sortWithinPartitions(*KEY, "shard", "window_id")

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, window, w, b, n = None, None, None, 0.0, 0
            m, along, bias = 0, 0.0, 0.0

            def step() -> None:
                nonlocal w, b, n
                rate = m / (n + m) if p.merge == "count" else 1.0
                w, b, n = w - p.step * rate * (w - p.cost / m * along), b + p.step_intercept * rate * p.cost / m * bias, n + m

            def done() -> pd.DataFrame:
                step()
                return pd.DataFrame({"model_id": [key[0]], "shard": [key[1]], "n": [n], "weights": [w], "intercept": [b]})

            for pdf in batches:
                for (*k, t), part in pdf.groupby(["model_id", "shard", "window_id"], sort=False):
                    if k != key:
                        if key is not None:
                            yield done()
                        key, n, w, b = k, 0, np.array(part["weights"].iloc[0]), float(part["intercept"].iloc[0])
                        window, m, along, bias = t, 0, 0.0, 0.0
                    elif t != window:
                        step()
                        window, m, along, bias = t, 0, 0.0, 0.0
                    x = np.stack(part["features"].to_numpy())
                    y = np.where(part["label"].to_numpy() > 0, 1.0, -1.0)
                    hit = y * (x @ w + b) < 1.0
                    m, along, bias = m + len(y), along + y[hit] @ x[hit], bias + y[hit].sum()
            if key is not None:
                yield done()

        kind = dict(rows.dtypes)["model_id"]
        return placed.mapInPandas(walk, f"model_id {kind}, shard long, n long, weights array<double>, intercept double")

    def merge_shards(self, shards: DataFrame, state: DataFrame | None) -> DataFrame:
        """Count-weighted mean of the shard models; rounds before count as one model."""
        d = self.params.dimension
        flat = [F.col("weights")[i].alias(f"w{i}") for i in range(d)]
        parts = shards.select(*KEY, "n", "intercept", *flat)
        if state is not None:
            parts = parts.unionByName(state.select(*KEY, "n", "intercept", *flat))
        merged = merge_by_count(parts, KEY, ["intercept", *[f"w{i}" for i in range(d)]])
        return merged.select(*KEY, "n", F.array(*[F.col(f"w{i}") for i in range(d)]).alias("weights"), "intercept")

    def ready(self, state: DataFrame) -> DataFrame:
        return state

    def score(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        """+1 where ``w.x + b > 0``, else -1."""
        joined = rows.join(state.select(*KEY, "weights", "intercept"), KEY)
        score = decision(F.col("features"), F.col("weights"), F.col("intercept"), self.params.dimension)
        return joined.withColumn("prediction", sign_of(score)).drop("weights", "intercept")

    def predict(self, rows: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        """Score unlabelled rows of a bounded table with the version before their window, those of the first window with the first."""
        me = self.with_params(**override)
        waiting = split_labelled(me.windowed(rows))[1]
        placed = waiting.withColumn("version", F.greatest(F.col("window_id") - 1, F.lit(0)))
        joined = placed.join(model.select(*KEY, "version", "weights", "intercept"), [*KEY, "version"])
        score = decision(F.col("features"), F.col("weights"), F.col("intercept"), me.params.dimension)
        return joined.withColumn("prediction", sign_of(score)).drop("weights", "intercept")
