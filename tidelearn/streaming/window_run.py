"""A learner fed by exact count windows of a stream, and its queue of waiting rows.

A micro-batch cuts a stream anywhere; windows do not follow it.  Labelled rows are numbered on from
the count before the batch, so window t holds the same W rows however they arrive, and its closing
makes version t.  The open window is kept as sums, not as rows: the state of a model has a fixed
size, and all sums combine before they are shuffled.

A closed window is also the moment at which a worker has a new model: it scores the W rows that
have waited longest, and leaves the others in line.  Waiting rows are written once, to the log of their batch;
the state only moves the place up to which the line was served.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelearn.functions.vectors import dot
from tidelearn.operators.moments import FLAT, cell_names, moments, moments_long, pack, pack_long
from tidelearn.operators.prefix import running_total
from tidelearn.operators.routing import sound, unlabel
from tidelearn.operators.windows import number_rows
from tidelearn.plans.learner import KEY, keyed, need_columns
from tidelearn.plans.moment_learners import MomentLearner
from tidelearn.session import materialize
from tidelearn.streaming.store import ModelStore

LINE = [*KEY, "place", "arrival", "seq", "features"]


class WindowRun:
    """Versions, pulls and predictions of one moment learner on one stream.

    Rows arrive in the order of ``seq``: later batches have later numbers.  Everything is stored under the batch
    number; a replayed batch starts from the state before it and overwrites what it wrote.
    """

    def __init__(self, spark: SparkSession, learner: MomentLearner, path: str):
        self.spark, self.learner, self.path = spark, learner, path.rstrip("/")
        store = lambda name: ModelStore(spark, f"{self.path}/{name}", "batch_id")
        self.models, self.sums, self.line, self.scored, self.rejected = map(store, ("models", "sums", "line", "predictions", "rejects"))
        self.places = store("places")
        d = learner.params.dimension
        self.wide = d > FLAT
        self.cells = ["g"] if self.wide else ["n", *cell_names(d)]
        self.keys = [*KEY, "i", "j"] if self.wide else KEY

    # Sums per window, flat or long, and what they are worth.

    def _sums(self, rows: DataFrame) -> DataFrame:
        d = self.learner.params.dimension
        return (moments_long if self.wide else moments)(rows, d, [*KEY, "window_id"])

    def _count(self, sums: DataFrame) -> DataFrame:
        """(model_id, window_id, n) of windows."""
        d = self.learner.params.dimension
        if self.wide:
            return sums.where((F.col("i") == d) & (F.col("j") == d)).select(*KEY, "window_id", F.col("g").cast("long").alias("n"))
        return sums.select(*KEY, "window_id", "n")

    def _versions(self, totals: DataFrame) -> DataFrame:
        """One solved model per running total."""
        d = self.learner.params.dimension
        packed = (pack_long if self.wide else pack)(totals, d, [*KEY, "window_id"])
        return packed.select(*KEY, F.col("window_id").alias("version"), F.col("n").cast("long").alias("n"), self.learner.weights().alias("weights"))

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        need_columns(batch, self.learner, "seq", "label", "features")
        p = self.learner.params
        rows, rejected = sound(keyed(batch).select(*KEY, "seq", "label", "features"), p.dimension)
        self.rejected.write(rejected, batch_id)
        state, places = self.sums.before(batch_id), self.places.before(batch_id)
        placed = materialize(self._placed(unlabel(rows, p.sentinel), places), "window-rows")
        new = self._sums(placed.where("label is not null").select(*KEY, "window_id", "label", "features"))
        if state is not None:
            new = new.unionByName(state.where("not closed").select(*new.columns))
        new = materialize(new.groupBy(*self.keys, "window_id").agg(*[F.sum(c).alias(c) for c in self.cells]), "window-sums")
        self._close(new, state, batch_id)
        self._serve(placed, places, batch_id)

    def _placed(self, rows: DataFrame, places: DataFrame | None) -> DataFrame:
        """Rows with the window that is open when they arrive (``window_id``) and, without a label, their place in line."""
        marked = rows.withColumns({"_labelled": F.col("label").isNotNull(), "_waits": F.col("label").isNull()})
        both = number_rows(number_rows(marked, "seq", KEY, "_labelled", name="_nth"), "seq", KEY, "_waits", name="place")
        if places is None:
            both = both.withColumns({"_seen": F.lit(0).cast("long"), "_lined": F.lit(0).cast("long")})
        else:
            before = places.select(*KEY, F.col("seen").alias("_seen"), F.col("lined").alias("_lined"))
            both = both.join(before, KEY, "left").fillna(0, ["_seen", "_lined"])
        window = F.expr(f"(_nth + _seen) div {self.learner.params.window}")
        return both.withColumn("window_id", window).withColumn("place", F.col("place") + F.col("_lined")).select(*KEY, "seq", "label", "features", "window_id", "place")

    def _close(self, new: DataFrame, state: DataFrame | None, batch_id: int) -> None:
        """Writes the versions of the windows that are full now, and the sums of the closed and the open ones."""
        full = self._count(new).where(F.col("n") == self.learner.params.window).select(*KEY, "window_id")
        closed = new.join(full, [*KEY, "window_id"], "left_semi")
        names = [*self.keys, "window_id", *self.cells]
        if state is not None:
            closed = closed.select(*names).unionByName(state.where("closed").select(*names))
        totals = running_total(closed.select(*names), self.keys, "window_id", self.cells)
        totals = materialize(totals, "window-totals")
        fresh = totals.join(full, [*KEY, "window_id"], "left_semi")
        self.models.write(self._versions(fresh), batch_id)
        last = totals.groupBy(*KEY).agg(F.max("window_id").alias("window_id"))
        kept = totals.join(last, [*KEY, "window_id"], "left_semi").select(*names).withColumn("closed", F.lit(True))
        opened = new.join(full, [*KEY, "window_id"], "left_anti").select(*names).withColumn("closed", F.lit(False))
        self.sums.write(kept.unionByName(opened), batch_id)

    def _serve(self, rows: DataFrame, places: DataFrame | None, batch_id: int) -> None:
        """Puts the unlabelled rows in line and lets each new version score the ``window`` rows at its head."""
        self.line.write(rows.where("label is null").select(*KEY, "place", F.col("window_id").alias("arrival"), "seq", "features"), batch_id)
        counts = rows.groupBy(*KEY).agg(F.count("label").alias("seen"), F.count_if(F.col("label").isNull()).alias("lined"))
        start = counts.select(*KEY, "seen", "lined", *[F.lit(0).cast("long").alias(c) for c in ("served", "oldest")], F.lit(True).alias("fresh"))
        if places is not None:
            start = start.unionByName(places.select(*KEY, "seen", "lined", "served", "oldest", F.lit(False).alias("fresh")))
        first = F.coalesce(F.max(F.when(~F.col("fresh"), F.col("oldest"))), F.lit(batch_id)).alias("oldest")
        now = materialize(start.groupBy(*KEY).agg(F.sum("seen").alias("seen"), F.sum("lined").alias("lined"), F.max("served").alias("served"), first), "window-places")
        versions = self.models.read(batch_id)
        pulls = materialize(self._pulls(versions, now, self._arrived(now, batch_id)), "window-pulls")
        ends = pulls.groupBy(*KEY).agg(F.max("high").alias("end"))
        after = now.join(ends, KEY, "left").withColumn("served", F.coalesce("end", "served"))
        # A line that is served to its end starts anew with the next batch.
        after = after.withColumn("oldest", F.when(F.col("served") >= F.col("lined"), F.lit(batch_id + 1)).otherwise(F.col("oldest")))
        self.places.write(after.select(*KEY, "seen", "lined", "served", "oldest"), batch_id)
        turns = pulls.select(*KEY, "version", F.explode(F.expr(f"if(high > low, sequence(low, high - 1), array())")).alias("place"))
        self.scored.write(self._scored(self._line(now, batch_id), turns, versions), batch_id)

    def _line(self, places: DataFrame, batch_id: int) -> DataFrame:
        """Rows still in line, from the logs of the batches since the oldest of them."""
        oldest = places.agg(F.min("oldest")).first()[0]
        logs = self.line.since(batch_id if oldest is None else min(oldest, batch_id), batch_id)
        rest = logs.join(places.select(*KEY, F.col("served").alias("_served")), KEY)
        return rest.where("place >= _served").select(*LINE)

    def _arrived(self, places: DataFrame, batch_id: int) -> DataFrame:
        """(model_id, arrival, m): rows in line by the window that was open when they came."""
        return self._line(places, batch_id).groupBy(*KEY, "arrival").agg(F.count("*").alias("m"))

    def _pulls(self, versions: DataFrame, places: DataFrame, arrived: DataFrame) -> DataFrame:
        """(model_id, version, low, high): the places that each warm version serves, at most ``window``.

        With A(p) rows in line by version p, the line is served up to S(p) = min(S(p-1) + W, A(p)), which is a running minimum: of
        A(j) + W (p - j) over j up to p, and S before + W for each version.
        """
        size, warm = self.learner.params.window, self.learner.params.warmup
        turns = versions.where(F.col("n") > warm).select(*KEY, F.col("version").alias("arrival"), F.lit(0).cast("long").alias("m"), F.lit(1).alias("pull"))
        events = turns.unionByName(arrived.select(*KEY, "arrival", "m", F.lit(0).alias("pull")))
        both = events.groupBy(*KEY, "arrival").agg(F.sum("m").alias("m"), F.sum("pull").alias("pull"))
        both = both.join(places.select(*KEY, "served"), KEY)
        order = Window.partitionBy(*KEY).orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
        stepped = both.withColumn("line", F.col("served") + F.sum("m").over(order)).withColumn("k", F.sum("pull").over(order)).where("pull = 1")
        slack = F.min(F.col("line") - size * F.col("k")).over(order)
        high = F.least(F.col("served") + size * F.col("k"), slack + size * F.col("k"))
        served = stepped.withColumn("high", high)
        before = F.lag("high").over(Window.partitionBy(*KEY).orderBy("arrival"))
        return served.select(*KEY, F.col("arrival").alias("version"), F.coalesce(before, F.col("served")).alias("low"), "high")

    def _scored(self, line: DataFrame, turns: DataFrame, versions: DataFrame) -> DataFrame:
        taken = line.join(turns, [*KEY, "place"]).join(versions.select(*KEY, "version", "weights"), [*KEY, "version"])
        prediction: Column = dot(F.col("features"), F.col("weights"), self.learner.params.dimension)
        return taken.select(*KEY, "seq", "version", prediction.alias("prediction"))

    def start(self, source: DataFrame, once: bool = True) -> StreamingQuery:
        writer = source.writeStream.foreachBatch(self.handle).option("checkpointLocation", f"{self.path}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def run(self, source: DataFrame, timeout: float | None = None) -> None:
        """Read what is there, then close."""
        query = self.start(source)
        query.awaitTermination(timeout)
        query.stop()
        self.close()

    def close(self) -> None:
        """End of stream: the open window makes a last version, and the newest version, if it is warm, serves the rest of the line."""
        known = self.sums.newest_number()
        if known is None:
            return
        state, places = self.sums.read(known), self.places.read(known)
        names = [*self.keys, "window_id", *self.cells]
        last = known + 1
        totals = running_total(state.select(*names), self.keys, "window_id", self.cells)
        opened = state.where("not closed").select(*KEY, "window_id").distinct()
        final = self._versions(totals.join(opened, [*KEY, "window_id"], "left_semi"))
        self.models.write(final, last)
        versions = self.models.all()
        newest = versions.groupBy(*KEY).agg(F.max_by(F.struct("version", "n", "weights"), "version").alias("m")).select(*KEY, "m.*").where(F.col("n") > self.learner.params.warmup)
        taken = self._line(places, known).join(newest, KEY)
        prediction = dot(F.col("features"), F.col("weights"), self.learner.params.dimension)
        self.scored.write(taken.select(*KEY, "seq", "version", prediction.alias("prediction")), last)

    def predictions(self) -> DataFrame | None:
        return self.scored.all()

    def versions(self) -> DataFrame | None:
        return self.models.all()
