"""Growing Gaussian mixture classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelearn.operators import mixture as mx
from tidelearn.operators.routing import sound, split_labelled, unlabel
from tidelearn.operators.windows import labelled_windows
from tidelearn.params import MixtureParams
from tidelearn.plans import blocks
from tidelearn.plans.learner import KEY, Stage, keyed, need_columns
from tidelearn.session import materialize, new_path
from tidelearn.streaming.store import ModelStore

# Rows of a model in a block of windows, at most.
BLOCK_ROWS = 1 << 16
ALL_STEPS = ("adopt", "em", "create", "merge", "split", "normalize")


class GrowingMixture(Stage):
    """Matches each window against the components as they stood at its start."""

    def __init__(self, params: MixtureParams = MixtureParams()):
        self.params = params

    def start(self, rows: DataFrame) -> DataFrame:
        p = self.params
        return mx.pack_components(mx.seed_components(rows, p.start_components, p.dimension), p.max_components)

    def update(self, batch: DataFrame, state: DataFrame | None) -> DataFrame:
        """The state after one window of every model; new models start from their first rows."""
        batch = batch.filter(F.col("label").isNotNull())
        if state is None:
            state = materialize(self.start(batch), "mixture-start")
        else:
            state = state.select(*KEY, "n", "comps")
            fresh = batch.join(state.select(*KEY), KEY, "left_anti")
            if not fresh.isEmpty():
                state = materialize(state.unionByName(self.start(fresh)), "mixture-start")
        return self.advance(batch, state)

    def advance(self, batch: DataFrame, state: DataFrame) -> DataFrame:
        """One window of labelled rows against models that all exist."""
        stats = mx.Matcher(state, self.params).window_stats(batch)
        return mx.advance(state, stats, self.params, ALL_STEPS)

    def windowed(self, rows: DataFrame) -> DataFrame:
        need_columns(rows, self, "seq", "label", "features")
        return labelled_windows(unlabel(sound(keyed(rows), self.params.dimension)[0], self.params.sentinel), self.params.window, keys=KEY)

    def rejects(self, rows: DataFrame) -> DataFrame:
        """Rows of another width, with nulls or NaN, or without an order key: they neither train nor are scored."""
        return sound(rows, self.params.dimension)[1]

    def fit(self, rows: DataFrame, **override) -> DataFrame:
        """Versions ``(model_id, version, n, comps)``, one per window."""
        me = self.with_params(**override)
        spark = rows.sparkSession
        span = blocks.span(me.params.window, BLOCK_ROWS)
        labelled = me.windowed(rows).filter(F.col("label").isNotNull()).withColumn("bucket", F.expr(f"window_id div {span}"))
        windows = materialize(labelled, "mixture-windows", ["bucket"])
        last = windows.agg(F.max("window_id")).first()[0]
        if last is None:
            raise ValueError("no rows to fit")
        store = ModelStore(spark, new_path(spark, "mixture-models"))
        # A model starts from its first rows, which are in its first window.
        state = materialize(me.start(windows.filter("bucket = 0 and window_id = 0").drop("bucket")), "mixture-start")
        models = state.count() if span > 1 else 0
        for low in range(0, last + 1, span):
            block, high = windows.filter(F.col("bucket") == low // span).drop("bucket"), min(low + span - 1, last)
            if span > 1:
                store.write_run(me.walk(block, state, low, high, models), low, high)
            else:
                store.write(me.advance(block, state), low)
            state = store.read(high)
        return store.all()

    def walk(self, rows: DataFrame, state: DataFrame, low: int, high: int, models: int) -> DataFrame:
        """The versions of some small windows, one after the other where a model's rows lie; as :meth:`advance` for each."""
        p = self.params

        def step(model: dict, part) -> dict:
            label, seq = (part.column(c).to_numpy() for c in ("label", "seq"))
            m, entries = mx.window_entries(model["comps"], blocks.matrix(part.column("features"), p.dimension), label, seq, p)
            return {"n": model["n"] + len(label), "comps": mx._moved(model["comps"], entries, m, p, ALL_STEPS)}

        wanted = rows.select(*KEY, "window_id", "seq", F.col("label").cast("int").cast("long").alias("label"), "features")
        return blocks.walk(wanted, state, "window_id", low, high, models, dict, step, mx.state_schema(state))

    def ready(self, state: DataFrame) -> DataFrame:
        return state.filter(F.col("n") > self.params.warmup)

    def score(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        return mx.Matcher(state, self.params).predict(rows)

    def predict(self, rows: DataFrame, model: DataFrame | None = None, **override) -> DataFrame:
        """Score unlabelled rows of a bounded table with the model of their time.

        A row in window t uses version t-1, or the first later one of more than ``warmup`` rows.  A model's version counts
        as a model of its own, so one job scores all versions: their components are sent to the tasks if they are few enough, else joined by
        model and version.  Rows of models that never warm up have a null version and prediction.
        """
        me = self.with_params(**override)
        waiting = split_labelled(me.windowed(rows))[1]
        first = me.ready(model).groupBy(*KEY).agg(F.min("version").alias("_first"))
        at = F.when(F.col("_first").isNotNull(), F.greatest(F.col("window_id") - 1, F.col("_first")))
        placed = materialize(waiting.join(first, KEY, "left").withColumn("version", at).drop("_first"), "mixture-waiting")
        named = F.concat_ws("/", F.col("model_id").cast("string"), F.col("version").cast("string"))
        asked = placed.filter("version is not null").withColumns({"_model": F.col("model_id"), "model_id": named})
        used = placed.filter("version is not null").select(*KEY, "version").distinct()
        own = materialize(model.select(*KEY, "version", "comps").join(used, [*KEY, "version"]).select(named.alias("model_id"), "comps"), "mixture-versions")
        scored = me.score(asked, own).withColumn("model_id", F.col("_model"))
        none = placed.filter("version is null").withColumn("prediction", F.lit(None).cast("double"))
        return none.unionByName(scored.select(*none.columns))
