"""Windows, prefix sums, routing and moments."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tidelearn.functions.noise import normal_pair, uniform
from tidelearn.operators import metrics, moments as mo, routing, windows
from tidelearn.operators.prefix import running_total
from tidelearn.operators.windows import count_windows, drop_tail, labelled_windows, number_rows


@pytest.fixture(scope="module")
def rows(spark):
    """Sparse, partly negative keys for two models; one holds most of the rows."""
    ids = spark.range(1000).select(((F.col("id") * 7919) % 100_003 - 50_000).alias("seq"))
    return ids.withColumn("model_id", F.when(F.col("seq") % 10 == 0, 1).otherwise(0)).withColumn(
        "hit", F.col("seq") % 3 == 0
    )


@pytest.mark.parametrize("width", [1, 500, 1 << 17])
def test_positions_equal_row_number(rows, width):
    got = number_rows(rows, keys=["model_id"], width=width)
    order = Window.partitionBy("model_id").orderBy("seq")
    both = got.withColumn("want", F.row_number().over(order) - 1)
    assert both.filter("position <> want").count() == 0 and both.count() == 1000


def test_counted_positions(rows):
    got = number_rows(rows, counted="hit", width=700)
    order = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    both = got.withColumn("want", F.coalesce(F.sum(F.col("hit").cast("long")).over(order), F.lit(0)))
    assert both.filter("position <> want").count() == 0


def test_tail_is_kept_or_dropped(rows):
    windows = count_windows(rows, 300)
    sizes = {r.window_id: r["count"] for r in windows.groupBy("window_id").count().collect()}
    assert sizes == {0: 300, 1: 300, 2: 300, 3: 100}
    assert drop_tail(windows, 300).count() == 900


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_total_in_blocks(rows, inclusive):
    frame = Window.partitionBy("model_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = rows.withColumn("v", F.lit(2)).withColumn("want", F.coalesce(F.sum("v").over(frame), F.lit(0)))
    assert running_total(df, ["model_id"], "seq", ["v"], block=64, inclusive=inclusive).filter("v <> want").count() == 0


def test_sparse_keys_leave_a_short_top_list(spark):
    """Ids far apart: positions are right, and blocks of blocks keep every group short."""
    far = spark.range(3000).select((F.col("id") * 10**12).alias("seq"))
    got = number_rows(far)
    assert got.filter("position <> seq div 1000000000000").count() == 0 and got.count() == 3000
    top = far.select(F.expr("(seq div 131072) div 4096 div 4096").alias("b")).distinct().count()
    assert top < 3000
    assert running_total(far.withColumn("v", F.lit(1)), [], "seq", ["v"], block=16, levels=3).filter("v <> seq div 1000000000000 + 1").count() == 0


def test_labelled_windows(spark):
    df = spark.range(20).select(F.col("id").alias("seq"), F.when(F.col("id") % 4 < 2, F.lit(1.0)).alias("label"))
    got = {r.seq: r.window_id for r in labelled_windows(df, 3).collect()}
    want = {i: sum(j % 4 < 2 for j in range(i)) // 3 for i in range(20)}
    assert got == want


def test_masks_and_splits(rows):
    labelled = rows.withColumn("label", F.lit(1.0))
    masked = routing.mask_tail(labelled, 0.15, -9.0)
    assert masked.filter("label = -9").count() == 150
    assert masked.filter("label = -9").agg(F.min("seq")).first()[0] > masked.filter("label = 1").agg(F.max("seq")).first()[0]
    train, waiting = routing.split_labelled(routing.unlabel(masked, -9.0))
    assert (train.count(), waiting.count()) == (850, 150)
    parts = routing.hash_split(rows, 0.33, seed=1)
    again = routing.hash_split(rows.repartition(7), 0.33, seed=1)
    assert parts.exceptAll(again).count() == 0
    assert 250 < parts.filter("part = 'test'").count() < 410


def test_sample_has_exact_size_and_repeats(rows):
    drawn = routing.sample_with_replacement(rows, 3000, seed=3, order="seq")
    assert drawn.count() == 3000 and drawn.select("seq").distinct().count() < 1000


def test_shards_and_width(spark, rows):
    sharded = routing.shard(rows, 4)
    assert sharded.rdd.getNumPartitions() == 4
    assert sharded.groupBy("shard").count().count() == 4
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, None],), (None,)], "features array<double>")
    good, bad = routing.of_width(df, 2)
    assert (good.count(), bad.count()) == (1, 3)


def test_slices_and_sparse_vectors(spark):
    df = spark.createDataFrame([(1, [0, 3], [1.0, 2.0]), (1, [3], [4.0]), (2, [1], [5.0])], "k int, slice array<int>, data array<double>")
    got = {r.k: r.features for r in routing.scatter_slices(df, 4, ["k"]).collect()}
    assert got == {1: [1.0, 0.0, 0.0, 6.0], 2: [0.0, 5.0, 0.0, 0.0]}


def _matrix(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.arange(1, d + 1) + rng.normal(size=n)
    return x, y


def _frame(spark, x, y, hide=()):
    data = [(i, 0, None if i in hide else float(y[i]), [float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(data, "seq long, model_id int, label double, features array<double>")


@pytest.mark.parametrize("d", [3, 40])
def test_prefix_moments_do_not_depend_on_layout(spark, d):
    x, y = _matrix(200, d)
    hide = set(range(50, 100)) | {3}
    df = _frame(spark, x, y, hide)
    keep = np.array([i not in hide for i in range(200)])
    for layout in (df.repartition(1), df.repartition(5)):
        got = mo.prefix_moments(count_windows(layout, 50, keys=["model_id"]), d, ["model_id"]).orderBy("window_id").collect()
        assert [r.n for r in got] == [49, 49, 99, 149]
        for t, r in enumerate(got):
            m = keep & (np.arange(200) < 50 * (t + 1))
            g = x[m].T @ x[m]
            assert np.allclose(r.xx, g[np.triu_indices(d)]) and np.allclose(r.xy, x[m].T @ y[m])


def test_long_moments_flush(spark, monkeypatch):
    x, y = _matrix(90, 4)
    df = _frame(spark, x, y).withColumn("k", F.col("seq") % 9)
    want = mo.moments_long(df, 4, ["k"]).orderBy("k", "i", "j").collect()
    monkeypatch.setattr(mo, "HELD_CELLS", 1)
    got = mo.moments_long(df, 4, ["k"]).orderBy("k", "i", "j").collect()
    assert len(got) == 9 * 15 and np.allclose([r.g for r in got], [r.g for r in want])


def test_merge_by_count(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 3, 6.0)], "model_id int, n long, w double")
    assert mo.merge_by_count(df, ["model_id"], ["w"]).first() == (0, 4, 5.0)


def test_noise_is_repeatable_and_normal(spark):
    a, b = normal_pair(F.col("id"), 1, 0)
    df = spark.range(20000).select("id", a.alias("a"), b.alias("b"), uniform(F.col("id"), 1, 9).alias("u"))
    s = df.agg(F.avg("a"), F.stddev("a"), F.corr("a", "b"), F.avg("u")).first()
    assert abs(s[0]) < 0.03 and abs(s[1] - 1) < 0.03 and abs(s[2]) < 0.03 and abs(s[3] - 0.5) < 0.01
    assert df.repartition(9).exceptAll(df).count() == 0


def test_bag_join_pairs_equal_values_one_to_one(spark):
    pred = spark.createDataFrame([(1.5, i, float(i)) for i in range(5)] + [(None, 9, 0.0), (2.0, 1, 7.0), (float("nan"), 1, 1.0)], "v double, a int, prediction double").repartition(3)
    truth = spark.createDataFrame([(1.5, i, -float(i)) for i in range(3)] + [(None, 1, 5.0), (3.0, 1, 8.0), (float("nan"), 4, 2.0), (float("nan"), 5, 3.0)], "v double, b int, truth double").repartition(2)
    got = metrics.bag_join(pred, truth, "v", ["a"], ["b"]).collect()
    both = sorted((repr(r.v), r.occurrence, r.prediction, r.truth) for r in got if r.side == "both")
    assert both == [("1.5", 0, 0.0, 0.0), ("1.5", 1, 1.0, -1.0), ("1.5", 2, 2.0, -2.0), ("None", 0, 0.0, 5.0), ("nan", 0, 1.0, 2.0)]
    assert sorted((r.v, r.prediction) for r in got if r.side == "pred") == [(1.5, 3.0), (1.5, 4.0), (2.0, 7.0)]
    assert sorted(r.truth for r in got if r.side == "truth") == [3.0, 8.0]
    assert metrics.bag_join(pred.where("false"), truth, "v", ["a"], ["b"]).count() == 7


def test_occurrences_of_a_hot_value(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id) v", "id o").repartition(7)
    got = windows.occurrences(rows, ["v"], ["o"]).collect()
    hot = sorted((r.o, r.occurrence) for r in got if r.v == 0)
    assert [k for _, k in hot] == list(range(len(hot))) and len(got) == 5000 and all(r.occurrence == 0 for r in got if r.v)
