"""One learner on a stream: score, train and commit per micro-batch."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelearn.operators.routing import sound, split_labelled, unlabel
from tidelearn.plans.learner import KEY, keyed, need_columns
from tidelearn.streaming.store import ModelStore

ROW = [*KEY, "seq", "label", "features"]


class StreamRun:
    """Predictions, waiting rows and model versions of one learner on one stream.

    Everything is stored under the batch number.  A batch that is replayed
    starts from the version before it and overwrites what it wrote, so rows
    count once even though ``foreachBatch`` runs at least once.
    """

    def __init__(self, spark: SparkSession, learner, path: str):
        self.spark, self.learner, self.path = spark, learner, path.rstrip("/")
        self.models = ModelStore(spark, f"{self.path}/models")
        self.scored = ModelStore(spark, f"{self.path}/predictions", "batch_id")
        self.rejected = ModelStore(spark, f"{self.path}/rejects", "batch_id")
        self.pending = ModelStore(spark, f"{self.path}/pending", "batch_id")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        """Score the waiting rows that have a warm model, then train on the labelled rows."""
        need_columns(batch, self.learner, "seq", "label", "features")
        sentinel = getattr(self.learner.params, "sentinel", None)
        rows = keyed(batch).select(*ROW)
        if hasattr(self.learner, "rejects"):
            rows, rejected = sound(rows, self.learner.params.dimension)
            self.rejected.write(rejected, batch_id)
        if sentinel is not None:
            rows = unlabel(rows, sentinel)
        # Read three times below; lost blocks are recomputed from the source.
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            labelled, waiting = split_labelled(rows)
            state = self.models.before(batch_id)
            held = self.pending.before(batch_id)
            if held is not None:
                waiting = waiting.unionByName(held.select(*ROW))
            self._score(waiting, state, batch_id)
            if state is None and labelled.isEmpty():
                return
            self.models.write(self.learner.update(labelled, state), batch_id)
        finally:
            rows.unpersist()

    def _score(self, waiting: DataFrame, state: DataFrame | None, batch_id: int) -> None:
        if state is None:
            self.pending.write(waiting, batch_id)
            return
        ready = self.learner.ready(state)
        version = state.agg(F.max("version")).first()[0]
        scored = self.learner.score(waiting, ready)
        out = scored.select(*KEY, "seq", "prediction", F.lit(version).cast("long").alias("version"))
        self.scored.write(out, batch_id)
        self.pending.write(waiting.join(ready.select(*KEY), KEY, "left_anti"), batch_id)

    def start(self, source: DataFrame, once: bool = True) -> StreamingQuery:
        """Run the stream; ``once`` reads what is there and stops."""
        writer = source.writeStream.foreachBatch(self.handle).option(
            "checkpointLocation", f"{self.path}/checkpoint"
        )
        if once:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def run(self, source: DataFrame, timeout: float | None = None) -> None:
        """Read what is there, then score the rows that still wait."""
        query = self.start(source)
        query.awaitTermination(timeout)
        query.stop()
        self.finish()

    def finish(self) -> None:
        """End of stream: waiting rows whose model is warm by now get the newest version."""
        last, state = self.pending.newest_number(), self.models.newest()
        if last is not None and state is not None:
            waiting = self.pending.read(last).select(*ROW)
            self._score(waiting, state, last + 1)

    def predictions(self) -> DataFrame | None:
        return self.scored.all()

    def versions(self) -> DataFrame | None:
        return self.models.all()
