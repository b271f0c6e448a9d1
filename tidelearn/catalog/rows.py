"""Queries on routing, windows, moments and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelearn.catalog.fixtures import (
    EVENT_LIST, LINES, ORD, SENTINEL, event_rank, line_rows, ord_rows, windowed,
)
from tidelearn.catalog.registry import register, table
from tidelearn.functions.vectors import clamp_at_zero, triangle
from tidelearn.operators import metrics, routing
from tidelearn.operators.moments import cell_names, merge_by_count as merge, moments, moments_long
from tidelearn.operators.prefix import running_total
from tidelearn.operators.windows import count_windows, drop_tail
from tidelearn.plans.learner import RowFunction
from tidelearn.plans.synth import synth_classes as make_classes, synth_regression as make_regression
from tidelearn.streaming.store import model_snapshots as snapshots


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("route_by_label", f"""
WITH {ORD}
SELECT CASE WHEN y IS NULL THEN 'waiting' ELSE 'labelled' END AS kind, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(coalesce(y, 0)) AS DOUBLE) AS sum_label
FROM ord GROUP BY 1""")
def route_by_label(spark, sf):
    rows = routing.unlabel(ord_rows(spark, sf), SENTINEL)
    labelled, waiting = routing.split_labelled(rows)
    both = labelled.select(F.lit("labelled").alias("kind"), "label").unionByName(
        waiting.select(F.lit("waiting").alias("kind"), "label")
    )
    return both.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("label", F.lit(0.0))).alias("sum_label")
    )


@register("mask_labels", f"""
WITH {ORD}
SELECT seq, CASE WHEN row_number() OVER (ORDER BY seq) - 1 >= floor(count(*) OVER () * (1 - 0.15e0))
                 THEN -9e0 ELSE label END AS label, label AS truth
FROM ord""")
def mask_labels(spark, sf):
    return routing.mask_tail(ord_rows(spark, sf).select("seq", "label"), 0.15, SENTINEL)


@register("shard_counts", f"""
WITH {ORD} SELECT CAST(seq % 8 AS INTEGER) AS shard, CAST(count(*) AS BIGINT) AS n FROM ord GROUP BY 1""")
def shard_counts(spark, sf):
    rows = ord_rows(spark, sf).select("seq")
    return rows.withColumn("shard", routing.shard_of(8, by=F.col("seq"))).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n")
    )


@register("hash_split", f"""
WITH {ORD}
SELECT seq, CASE WHEN CAST('0x' || substr(md5('7:' || seq), 1, 8) AS BIGINT) % 10000 < 3300 THEN 'test' ELSE 'train' END AS part FROM ord""")
def hash_split(spark, sf):
    return routing.hash_split(ord_rows(spark, sf).select("seq"), 0.33, seed=7)


@register("scatter_slices", f"""
WITH cells AS (
  SELECT user_id, list_position({EVENT_LIST}, event_type) - 1 AS i, value AS v FROM events
  UNION ALL SELECT user_id, 5, 1e0 FROM events),
sums AS (SELECT user_id, i, sum(v) AS v FROM cells GROUP BY 1, 2),
users AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, CAST(g.i AS INTEGER) AS i, round(coalesce(s.v, 0), 4) AS v
FROM users u CROSS JOIN generate_series(0, 5) g(i) LEFT JOIN sums s ON s.user_id = u.user_id AND s.i = g.i""")
def scatter_slices(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id",
        F.array(event_rank(), F.lit(5)).alias("slice"),
        F.array(F.col("value"), F.lit(1.0)).alias("data"),
    )
    dense = routing.scatter_slices(events, 6, ["user_id"])
    return rounded(dense.select("user_id", F.posexplode("features").alias("i", "v")), 4, "v")


WINDOW_SUMMARY = "window_id, CAST(count(*) AS BIGINT) AS n, min(seq) AS min_seq, max(seq) AS max_seq"


def _window_summary(windows):
    return windows.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


@register("count_windows", f"""
WITH {ORD}, {windowed('700')}
SELECT {WINDOW_SUMMARY} FROM win GROUP BY window_id HAVING count(*) = 700""")
def count_windows_full(spark, sf):
    return _window_summary(drop_tail(count_windows(ord_rows(spark, sf).select("seq"), 700), 700))


@register("tail_flush", f"WITH {ORD}, {windowed('700')} SELECT {WINDOW_SUMMARY} FROM win GROUP BY window_id")
def tail_flush(spark, sf):
    return _window_summary(count_windows(ord_rows(spark, sf).select("seq"), 700))


def _long(df, d, keys):
    """Moment columns to rows ``(i, j, g)``; ``j = d`` is ``sum y x``."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"xx_{i}_{j}").alias("g")) for i, j in triangle(d)]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(d).alias("j"), F.col(f"xy_{i}").alias("g")) for i in range(d)]
    return df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(
        *keys, "c.i", "c.j", F.round("c.g", 4).alias("g")
    )


def _long_sql(d, source, keys=""):
    """One aggregate per cell, turned into rows."""
    names = [f"x{i + 1}" for i in range(d)]
    cells = [(i, j, f"{names[i]} * {names[j]}") for i, j in triangle(d)]
    cells += [(i, d, f"{names[i]} * y") for i in range(d)]
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {lead}CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, "
        f"round(coalesce(sum({e}), 0), 4) AS g FROM {source} {group}"
        for i, j, e in cells
    )


@register("moments", f"WITH {LINES} {_long_sql(3, 'li')}")
def moments_flat(spark, sf):
    return _long(moments(line_rows(spark, sf, 3), 3, []), 3, [])


PREFIX_SQL = f"""
WITH {ORD}, {windowed('1000')},
cells AS ({_long_sql(2, '(SELECT window_id, CASE WHEN y IS NOT NULL THEN x1 END AS x1, CASE WHEN y IS NOT NULL THEN x2 END AS x2, y FROM win)', 'window_id').replace('round(coalesce(sum(', 'coalesce(sum((').replace('), 0), 4) AS g', ')), 0) AS g')})
SELECT window_id, i, j, round(sum(g) OVER (PARTITION BY i, j ORDER BY window_id), 4) AS g FROM cells"""


@register("moments_prefix", PREFIX_SQL)
def moments_prefix(spark, sf):
    rows = count_windows(routing.unlabel(ord_rows(spark, sf), SENTINEL), 1000)
    total = running_total(moments(rows, 2, ["window_id"]), [], "window_id", cell_names(2))
    return _long(total, 2, ["window_id"])


@register("moments_wide", """
WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS y FROM embeddings),
z AS (SELECT list_append(x, y) AS z FROM e),
c AS (SELECT i, j FROM generate_series(0, 64) a(i), generate_series(0, 64) b(j) WHERE i <= j AND i < 64)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(z[i + 1] * z[j + 1]), 5) AS g
FROM z CROSS JOIN c GROUP BY ALL""")
def moments_wide(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("embedding").alias("features"), "label")
    cells = moments_long(rows, 64, [])
    return rounded(cells.filter(F.col("i") < 64), 5, "g")


@register("merge_by_count", """
WITH s AS (
  SELECT o_orderpriority AS model_id, o_orderkey % 8 AS shard, count(*) AS n,
         avg(o_totalprice / 500000e0) AS w1, avg(CAST(month(o_orderdate) AS DOUBLE) / 12e0) AS w2
  FROM orders GROUP BY 1, 2)
SELECT model_id, CAST(sum(n) AS BIGINT) AS n, round(sum(n * w1) / sum(n), 6) AS w1,
       round(sum(n * w2) / sum(n), 6) AS w2
FROM s GROUP BY 1""")
def merge_by_count(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model_id"),
        routing.shard_of(8, by=F.col("o_orderkey")).alias("shard"),
        (F.col("o_totalprice") / 500000.0).alias("w1"),
        (F.month("o_orderdate").cast("double") / 12.0).alias("w2"),
    )
    shards = rows.groupBy("model_id", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.avg("w1").alias("w1"), F.avg("w2").alias("w2")
    )
    return rounded(merge(shards, ["model_id"], ["w1", "w2"]), 6, "w1", "w2")


VERSIONS = f"""
WITH {ORD}, {windowed('500')},
per AS (SELECT window_id AS version, count(y) AS m FROM win GROUP BY 1),
ver AS (SELECT CAST(0 AS INTEGER) AS model_id, version, CAST(sum(m) OVER (ORDER BY version) AS BIGINT) AS n FROM per)"""


def _versions(spark, sf):
    rows = routing.with_model(routing.unlabel(ord_rows(spark, sf), SENTINEL)).select("model_id", "seq", "label")
    per = count_windows(rows, 500, keys=["model_id"], name="version")
    counts = per.groupBy("model_id", "version").agg(F.count("label").alias("n"))
    return running_total(counts, ["model_id"], "version", ["n"])


@register("model_versions", f"{VERSIONS} SELECT * FROM ver")
def model_versions(spark, sf):
    return _versions(spark, sf)


@register("model_snapshots", f"""{VERSIONS},
step AS (SELECT *, floor(n / 2000e0) AS s FROM ver)
SELECT model_id, min(version) AS version, CAST(arg_min(n, version) AS BIGINT) AS n FROM step WHERE s > 0 GROUP BY model_id, s""")
def model_snapshots(spark, sf):
    return snapshots(_versions(spark, sf), 2000)


# A fixed rule stands for a classifier: class 1 when the price share is high.
RULE = "CASE WHEN x1 > 0.5e0 THEN 1e0 ELSE 0e0 END"


def _rule():
    return F.when(F.col("features")[0] > 0.5, F.lit(1.0)).otherwise(F.lit(0.0))


@register("accuracy_join", f"""
WITH {ORD}, pred AS (SELECT seq, {RULE} AS p FROM ord), truth AS (SELECT seq, y FROM ord WHERE y IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (p = y) AS BIGINT) AS n_right,
       round(avg(CASE WHEN p = y THEN 1e0 ELSE 0e0 END), 6) AS accuracy
FROM truth LEFT JOIN pred USING (seq)""")
def accuracy_join(spark, sf):
    rows = routing.unlabel(ord_rows(spark, sf), SENTINEL)
    pred = rows.filter("label is not null").select("seq", _rule().alias("prediction"))
    truth = rows.filter("label is not null").select("seq", F.col("label").alias("truth"))
    return rounded(metrics.accuracy(metrics.join_truth(pred, truth)), 6, "accuracy")


@register("label_agreement", f"""
WITH {ORD}, a AS (SELECT seq, {RULE} AS p FROM ord), b AS (SELECT seq, CASE WHEN x2 > 0.5e0 THEN 1e0 ELSE -1e0 END AS q FROM ord)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (2 * p - 1 = q) AS BIGINT) AS n_right,
       round(avg(CASE WHEN 2 * p - 1 = q THEN 1e0 ELSE 0e0 END), 6) AS accuracy
FROM a JOIN b USING (seq)""")
def label_agreement(spark, sf):
    rows = ord_rows(spark, sf)
    first = rows.select("seq", _rule().alias("prediction"))
    second = rows.select("seq", F.when(F.col("features")[1] > 0.5, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("truth"))
    return rounded(metrics.accuracy(metrics.join_truth(first, second)), 6, "accuracy")


@register("regression_metrics", f"""
WITH {LINES}, p AS (SELECT y, 0.9e0 * x1 + 0.1e0 AS p FROM li)
SELECT round(avg((y - p) * (y - p)), 6) AS mse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM p""")
def regression_metrics(spark, sf):
    rows = line_rows(spark, sf).withColumn("prediction", 0.9 * F.col("features")[0] + 0.1)
    return rounded(metrics.regression_metrics(rows), 6, "mse", "r2")


def _unit_sql(stream, seed, start):
    return (f"((CAST('0x' || substr(md5(seq || ':{seed}:{stream}'), {start}, 13) AS BIGINT) + 1e0) / 4503599627370496e0)")


def _normals_sql(seed, count):
    out = []
    for s in range((count + 1) // 2):
        radius, angle = f"sqrt(-2e0 * ln({_unit_sql(s, seed, 1)}))", f"(2e0 * pi() * {_unit_sql(s, seed, 14)})"
        out += [f"{radius} * cos({angle})", f"{radius} * sin({angle})"]
    return out[:count]


TRUE_COEF = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0]
REG_SQL = f"""
WITH {ORD}, z AS (SELECT seq, {', '.join(f'{e} AS z{i}' for i, e in enumerate(_normals_sql(3, 8)))} FROM ord)
SELECT seq, round({' + '.join(f'{c} * z{i}' for i, c in enumerate(TRUE_COEF))} + 0.01e0 * z7, 5) AS label,
       {', '.join(f'round(z{i}, 6) AS f{i + 1}' for i in range(7))}
FROM z"""


def _spread(df, d, digits=6):
    return df.select(
        "seq", F.round("label", 5).alias("label"), *[F.round(F.col("features")[i], digits).alias(f"f{i + 1}") for i in range(d)]
    )


@register("synth_regression", REG_SQL)
def synth_regression(spark, sf):
    return _spread(make_regression(ord_rows(spark, sf).select("seq"), TRUE_COEF, 0.01, seed=3), 7)


@register("synth_classes", f"""
WITH {ORD}, z AS (
  SELECT seq, {_unit_sql(1000, 5, 1)} <= 0.5e0 AS c, {_unit_sql(1001, 5, 1)} <= 0.01e0 AS f,
         {', '.join(f'{e} AS z{i}' for i, e in enumerate(_normals_sql(5, 7)))} FROM ord)
SELECT seq, CASE WHEN c <> f THEN 1e0 ELSE 0e0 END AS label,
       {', '.join(f'round(z{i} + CASE WHEN c THEN 1e0 ELSE -1e0 END, 6) AS f{i + 1}' for i in range(7))}
FROM z""")
def synth_classes(spark, sf):
    return _spread(make_classes(ord_rows(spark, sf).select("seq"), 7, seed=5), 7)


# Truth and predictions know each other by the price alone, which many lines share; returned lines are predicted, the others not.
BAG = """
WITH t AS (SELECT l_extendedprice AS price, CASE WHEN l_discount > 0.05 THEN 1e0 ELSE -1e0 END AS truth,
             row_number() OVER (PARTITION BY l_extendedprice ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem),
p AS (SELECT l_extendedprice AS price, CASE WHEN l_tax > 0.03 THEN 1e0 ELSE -1e0 END AS prediction,
        row_number() OVER (PARTITION BY l_extendedprice ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag <> 'N')"""


def _bag(spark, sf):
    lines = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice").alias("price")
    truth = lines.select(price, F.when(F.col("l_discount") > 0.05, 1.0).otherwise(-1.0).alias("truth"), F.col("l_orderkey").alias("to"), F.col("l_linenumber").alias("tl"))
    pred = lines.where("l_returnflag <> 'N'").select(price, F.when(F.col("l_tax") > 0.03, 1.0).otherwise(-1.0).alias("prediction"), F.col("l_orderkey").alias("po"), F.col("l_linenumber").alias("pl"))
    return pred, truth


@register("accuracy_bag_join", f"""{BAG}
SELECT count(*) FILTER (p.k IS NOT NULL AND t.k IS NOT NULL) AS n, count(*) FILTER (prediction = truth) AS n_right,
  count(*) FILTER (p.k IS NULL) AS truth_only, count(*) FILTER (t.k IS NULL) AS pred_only
FROM p FULL JOIN t ON p.price = t.price AND p.k = t.k""")
def accuracy_bag_join(spark, sf):
    pred, truth = _bag(spark, sf)
    joined = metrics.bag_join(pred, truth, "price", ["po", "pl"], ["to", "tl"])
    return joined.agg(
        F.count_if(F.col("side") == "both").alias("n"), F.count_if(F.col("prediction") == F.col("truth")).alias("n_right"),
        F.count_if(F.col("side") == "truth").alias("truth_only"), F.count_if(F.col("side") == "pred").alias("pred_only"),
    )


@register("truth_duplicates", f"{BAG} SELECT price, count(*) AS n FROM t GROUP BY price HAVING count(*) > 1")
def truth_duplicates(spark, sf):
    """Values that a join on the value alone would match more than once."""
    return metrics.duplicate_keys(_bag(spark, sf)[1], "price")


# Vectors of one, two or three numbers by status; a learner of width two rejects the others.
@register("width_check", f"""
WITH {ORD}
SELECT label <> -9e0 AS good, count(*) AS n, round(sum(x1), 4) AS total FROM ord GROUP BY 1""")
def width_check(spark, sf):
    x, label = F.col("features"), F.col("label")
    width = F.when(label == SENTINEL, F.slice(x, 1, 1)).otherwise(x)
    good, bad = routing.of_width(ord_rows(spark, sf).withColumn("features", width), 2)
    both = good.select(F.lit(True).alias("good"), F.col("features")[0].alias("x1")).union(bad.select(F.lit(False), F.col("features")[0]))
    return both.groupBy("good").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x1"), 4).alias("total"))


@register("row_function", f"WITH {ORD} SELECT seq, round(0.75e0 * x1 - 0.5e0 * x2 + 0.125e0, 9) AS prediction FROM ord")
def row_function(spark, sf):
    """A user's function on batches of vectors with its own model."""
    step = RowFunction(lambda model, x: x @ model["weights"] + model["intercept"], {"weights": [0.75, -0.5], "intercept": 0.125})
    return rounded(step.predict(ord_rows(spark, sf)).select("seq", "prediction"), 9, "prediction")
