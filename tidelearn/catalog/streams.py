"""Queries that run as streams over the given tables, and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelearn.catalog.fixtures import ORD, SENTINEL, ord_rows
from tidelearn.catalog.linear import RIDGE_FIT, flat, solve2
from tidelearn.catalog.registry import register, table
from tidelearn.operators.routing import unlabel, with_model
from tidelearn.params import RidgeParams
from tidelearn.plans.moment_learners import Ridge
from tidelearn.session import new_path
from tidelearn.streaming.driver import StreamRun
from tidelearn.streaming.event_time import window_models, window_moments
from tidelearn.streaming.exact_windows import exact_windows, open_windows, start_windows
from tidelearn.streaming.store import ModelStore
from tidelearn.streaming.window_run import WindowRun

RIDGE = Ridge(RidgeParams(dimension=2, sentinel=SENTINEL))

# Per day and event type: value on the share of the day that has passed, and a constant.
DAYS = f"""
WITH e AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS model_id, CAST(hour(ts) AS DOUBLE) / 24e0 AS x1, 1e0 AS x2,
         value / 100e0 AS y FROM events),
m AS (SELECT day, model_id, count(*) AS n, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22,
             sum(x1 * y) AS r1, sum(x2 * y) AS r2 FROM e GROUP BY 1, 2),
fit AS ({solve2('m', 'day, model_id, CAST(n AS BIGINT) AS n')})
SELECT day, model_id, n, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM fit"""


def _event_rows(events):
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model_id"),
        (F.col("value") / 100.0).alias("label"),
        F.array(F.hour("ts").cast("double") / 24.0, F.lit(1.0)).alias("features"),
    )


def _days(models):
    return flat(models.withColumn("day", F.date_format("window.start", "yyyy-MM-dd")), "day", "model_id", "n")


@register("ridge_event_windows", DAYS)
def ridge_event_windows(spark, sf):
    rows = _event_rows(table(spark, sf, "events"))
    return _days(window_models(window_moments(rows, 2, "1 day", ["model_id"]), RIDGE, ["model_id"]))


def _file_stream(spark, sf, name):
    # A pattern, so that a table may be one file or a folder of files.
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parquet*")


@register("ridge_event_stream", DAYS)
def ridge_event_stream(spark, sf):
    """The same models from a stream with a watermark; each trigger rewrites the windows it changed."""
    rows = _event_rows(_file_stream(spark, sf, "events"))
    sums = window_moments(rows, 2, "1 day", ["model_id"], late="2 days")
    path = new_path(spark, "event-stream")
    store = ModelStore(spark, f"{path}/models")
    query = (
        sums.writeStream.outputMode("complete")
        .foreachBatch(lambda batch, batch_id: store.write(window_models(batch, RIDGE, ["model_id"]), batch_id))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _days(store.newest())


@register("ridge_stream", f"""
WITH {ORD}, m AS (
  SELECT count(*) AS n, sum(x1 * x1) AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) AS a22, sum(x1 * y) AS r1, sum(x2 * y) AS r2
  FROM ord WHERE y IS NOT NULL),
fit AS ({solve2('m', 'CAST(n AS BIGINT) AS n')})
SELECT seq, round(w1 * x1 + w2 * x2, 5) AS prediction FROM ord, fit WHERE y IS NULL""")
def ridge_stream(spark, sf):
    """Orders as a stream: all rows arrive at once, wait for the model and are scored at the end."""
    orders = _file_stream(spark, sf, "orders")
    status = F.col("o_orderstatus")
    rows = orders.select(
        F.col("o_orderkey").alias("seq"),
        F.when(status == "F", F.lit(1.0)).when(status == "O", F.lit(0.0)).otherwise(F.lit(SENTINEL)).alias("label"),
        F.array(F.col("o_totalprice") / 500000.0, F.month("o_orderdate").cast("double") / 12.0).alias("features"),
    )
    run = StreamRun(spark, RIDGE, new_path(spark, "ridge-stream"))
    run.run(rows)
    return run.predictions().select("seq", F.round("prediction", 5).alias("prediction"))


@register("stream_count_windows", f"""
WITH {ORD}, s AS (SELECT seq % 8 AS shard, count(*) AS m FROM ord WHERE y IS NOT NULL GROUP BY 1)
SELECT CAST(0 AS INTEGER) AS model_id, CAST(shard AS INTEGER) AS shard, CAST(w AS BIGINT) AS window_id, CAST(least(50, m - 50 * w) AS BIGINT) AS n
FROM s, LATERAL (SELECT unnest(range((m + 49) // 50)) AS w) t""")
def stream_count_windows(spark, sf):
    """Windows of exactly 50 labelled rows per shard, closed as rows arrive; the last ones are closed at the end of the stream."""
    orders = _file_stream(spark, sf, "orders")
    status = F.col("o_orderstatus")
    rows = with_model(orders.select(
        F.col("o_orderkey").alias("seq"),
        F.when(status == "F", F.lit(1.0)).when(status == "O", F.lit(0.0)).alias("label"),
        F.array(F.col("o_totalprice") / 500000.0).alias("features"),
    ))
    path = new_path(spark, "exact-windows")
    store = ModelStore(spark, f"{path}/windows", "batch_id")
    query = start_windows(exact_windows(rows, 50, 1, 8, by=F.col("seq")), store.write, f"{path}/checkpoint")
    query.awaitTermination()
    closed = store.all().select("model_id", "shard", "window_id", "n")
    return closed.union(open_windows(spark, f"{path}/checkpoint").select(*closed.columns))


PARTS = 3
PULL_RIDGE = Ridge(RidgeParams(dimension=2, window=1000, warmup=2000, sentinel=SENTINEL))


def _arriving(spark, sf):
    """The orders as a stream that arrives in ``PARTS`` files, one micro-batch each, cut by the order key and not by windows."""
    rows, path = ord_rows(spark, sf), new_path(spark, "arriving")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    part = F.expr(f"cast((seq - {low}) * {PARTS} div ({high} - {low} + 1) as int)") if low is not None else F.lit(0)
    for k in range(PARTS):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _window_run(spark, sf):
    run = WindowRun(spark, PULL_RIDGE, new_path(spark, "window-run"))
    run.run(_arriving(spark, sf))
    return run


@register("stream_window_ridge", f"{RIDGE_FIT} SELECT version, n, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM fit")
def stream_window_ridge(spark, sf):
    """Ridge versions of the orders stream: windows of exactly 1,000 labelled rows, whatever micro-batches cut it; same models as ``ridge_fit``."""
    return flat(_window_run(spark, sf).versions(), "version", "n")


# Version p serves up to 1,000 rows that arrived by its closing; what is left at the end goes to the newest.
@register("stream_pulls", f"""
{RIDGE_FIT.replace("WITH", "WITH RECURSIVE", 1)},
line AS (SELECT seq, window_id, x1, x2, row_number() OVER (ORDER BY seq) - 1 AS place FROM win WHERE y IS NULL),
full_fit AS (SELECT * FROM fit WHERE n = 1000 * (version + 1)),
came AS (SELECT f.version, (SELECT count(*) FROM line WHERE window_id <= f.version) AS a FROM full_fit f WHERE n > 2000),
pull AS (
  SELECT version, CAST(0 AS BIGINT) AS low, CAST(least(1000, a) AS BIGINT) AS high FROM came WHERE version = (SELECT min(version) FROM came)
  UNION ALL
  SELECT came.version, pull.high, CAST(least(pull.high + 1000, a) AS BIGINT) FROM pull JOIN came ON came.version = pull.version + 1),
served AS (SELECT seq, x1, x2, coalesce(p.version, (SELECT max(version) FROM fit WHERE n > 2000)) AS version
           FROM line LEFT JOIN pull p ON place >= low AND place < high)
SELECT seq, version, round(w1 * x1 + w2 * x2, 5) AS prediction FROM served JOIN fit USING (version)""")
def stream_pulls(spark, sf):
    """Predictions of the orders stream: each new version serves the 1,000 rows that have waited longest."""
    scored = _window_run(spark, sf).predictions()
    return scored.select("seq", "version", F.round("prediction", 5).alias("prediction"))
